"""Line dedup by pairwise alignment: common blocks go from the later document."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bloom import split_by_filter
from fleetlens.llm.common import Texts, record, small_batches, ways, written

WINDOW = 16  # one cut at least among so many places between words of a line
WORD, LETTER = 4, 1  # what a word weighs, and a character of a long run without blanks
LONG_RUN = 48  # bytes from which a run without blanks counts by its characters
LEAST_WEIGHT = 12 * WORD  # lighter repeated runs stay
LEAST_BLOCK = 8 * WORD  # what one earlier document must share in a row
SLICE_BYTES = 2 << 20  # a longer text is cut into pieces slice by slice
NEAR_BYTES = 256  # text beside a block that is looked at when it is extended
SAMPLE_ROWS = 1 << 20  # pieces among which frequent ones are looked for

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(values: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of each slice ``values[first:after]``, the same wherever the slice is."""
    base, back = _ODD, np.uint64(pow(int(_ODD), -1, 1 << 64))
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(values), base)]))
    undo = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(values), back)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:-1])])
    return _mix((sums[after] - sums[first]) * undo[first] + (after - first).astype(np.uint64))


def _least_of(values: np.ndarray, window: int, at_most: bool) -> np.ndarray:
    """The least (or the most) of each ``window`` values in a row, by doubling."""
    pick = np.minimum if at_most else np.maximum
    width = 1
    while width < window:
        step = min(width, window - width)
        values = pick(values[:-step], values[step:])
        width += step
    return values


def _winnowed(places: np.ndarray) -> np.ndarray:
    """Which of the values are the least of some ``WINDOW`` in a row."""
    if len(places) < WINDOW:
        return places == places.min(initial=np.iinfo(places.dtype).max)
    least = _least_of(places, WINDOW, True)
    edge = np.zeros(WINDOW - 1, places.dtype)
    return _least_of(np.concatenate([edge, least, edge]), WINDOW, False) == places


class Pieces:
    """The pieces of lines of some texts: bytes they take, what they weigh, and their keys.

    A line is cut into words, and runs of ``LONG_RUN`` bytes without blanks, as in scripts
    that have none, into characters. A piece ends with its line, or between two words whose
    hash is the least among ``WINDOW`` such places in a row. So a passage falls into the
    same pieces wherever in a line it stands, but for a window at each end, and any passage
    of two windows has a whole piece. The key is a hash of the words.
    """

    def __init__(self, texts: Texts):
        data, starts = texts.data, texts.starts
        n = len(data)
        word = ~_BLANK[data]
        fresh = np.zeros(n + 1, bool)
        fresh[starts] = True
        begins = word & (fresh[:n] | ~np.concatenate([[False], word[:-1]])) if n else word
        ends = word & (fresh[1:] | ~np.concatenate([word[1:], [False]])) if n else word
        first, after = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = after - first >= LONG_RUN
        weight = np.where(long, LETTER, WORD).astype(np.int32)
        if long.any():
            cover = np.zeros(n + 1, np.int8)
            cover[first[long]] += 1
            cover[after[long]] -= 1
            begins |= (np.cumsum(cover[:-1]) > 0) & ((data & 0xC0) != 0x80)
            whole, whole_after, first = first, after, np.flatnonzero(begins)
            owner = np.searchsorted(whole, first, "right") - 1
            after = np.minimum(np.append(first[1:], n), whole_after[owner])
            weight = weight[owner]
        doc = np.searchsorted(starts, first, "right") - 1
        with np.errstate(over="ignore"):
            hashed = _hashes(data.astype(np.uint64) + np.uint64(1), first, after)
            lines = np.concatenate([[0], np.cumsum(data == 10)])[first]
            apart = np.ones(len(first) + 1, bool)  # from the word before by a line or text
            apart[1:-1] = (lines[1:] != lines[:-1]) | (doc[1:] != doc[:-1])
            places = np.zeros(len(first) + 1, np.uint64)
            places[1:-1] = _mix(hashed[:-1] * _ODD + hashed[1:]) | np.uint64(1)
            places[apart] = 0
            start = np.flatnonzero(_winnowed(places)[:-1]) if len(first) else first
            last = np.append(start[1:], len(first)).astype(np.int64)
            self.keys = _hashes(hashed, start, last).astype(np.int64) if len(first) else np.zeros(0, np.int64)
        self.doc = doc[start]
        upto = np.concatenate([[0], np.cumsum(weight)])
        self.weight = (upto[last] - upto[start]).astype(np.int32) if len(first) else np.zeros(0, np.int32)
        # A piece takes the bytes up to the next one, the text's last up to its end.
        self.begin = first[start]
        self.end = np.append(self.begin[1:], n)[: len(self.begin)]
        closing = np.append(self.doc[1:] != self.doc[:-1], True)[: len(self.doc)]
        self.end[closing] = starts[self.doc[closing] + 1]


def _slices(text: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of a text and where they start: cut after a line's end, else a blank, else a character."""
    at = 0
    while at < len(text):
        end = min(len(text), at + limit)
        if end < len(text):
            part = text[at:end]
            for marks in (part == 10, _BLANK[part]):
                if marks.any():
                    end = at + int(np.flatnonzero(marks)[-1]) + 1
                    break
            else:
                while end - 1 > at and text[end] & 0xC0 == 0x80:
                    end -= 1
        yield at, text[at:end]
        at = end


def _cut(texts: Texts, limit: int) -> Iterator[tuple[np.ndarray, Pieces]]:
    """Pieces of a few texts, and what is to be added to their places to be those in their text."""
    if len(texts) > 1 or len(texts.data) <= limit:
        yield -texts.starts[:-1], Pieces(texts)
        return
    for at, part in _slices(texts.data, limit):
        p = Pieces(Texts(texts.ids, part, np.array([0, len(part)]), texts.rows))
        if at and len(p.begin):
            p.begin[0] = 0
        yield np.array([at]), p


def aligned(blocks: list[tuple[int, int]]) -> list[int]:
    """Patience: of common blocks, given by places in the later and the earlier document in the
    order of the former, the longest run that rises in both. Gives their numbers."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for i, (_, earlier) in enumerate(blocks):
        pile = bisect_left(tops, earlier)
        before.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(earlier)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = earlier, i
    run, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        run.append(i)
        i = before[i]
    return run[::-1]


def repeated_ranges(blocks: list[tuple]) -> list[tuple[tuple, tuple]]:
    """Of one document's blocks ``(begin, end, source, at, at_end, weight)``, in order, the first
    and the last of each run that goes.

    Of each source's blocks those count that patience aligns, and those that are long enough
    wherever they stand. A run of such blocks without a gap goes if it is long enough, and
    one of its blocks is.
    """
    by_source: dict[object, list[int]] = {}
    for i, block in enumerate(blocks):
        by_source.setdefault(block[2], []).append(i)
    counts = {i for i, b in enumerate(blocks) if b[5] >= LEAST_BLOCK}
    for mine in by_source.values():
        counts.update(mine[j] for j in aligned([(blocks[i][0], blocks[i][3]) for i in mine]))
    gone, run = [], []
    for block in [*(blocks[i] for i in sorted(counts)), None]:
        if run and (block is None or block[0] != run[-1][1]):
            if sum(b[5] for b in run) >= LEAST_WEIGHT and any(b[5] >= LEAST_BLOCK for b in run):
                gone.append((run[0], run[-1]))
            run = []
        run.append(block)
    return gone


def _same_as_before(column: pa.Array) -> np.ndarray:
    """Of values in a row, which equal the one before; the first doesn't."""
    if len(column) < 2:
        return np.zeros(len(column), bool)
    same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
    return np.concatenate([[False], same.to_numpy(zero_copy_only=False)])


def _halves(places: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = places.to_numpy(zero_copy_only=False).astype(np.int64)
    return both >> 32, both & 0xFFFFFFFF


def _links(pieces: DataFrame, kind: str) -> DataFrame:
    """Each piece that an earlier document has, with the first place of those that have it:
    ``(id, h, place, weight, src, src_h, src_place)``.

    Pieces meet by key, the first place in front. Keys that hold so many pieces that one
    task would have far more than the others don't: there are few of them, as is known from
    a sample, so their first places go to every task instead.
    """
    spark = pieces.sparkSession
    rows, parts = pieces.count(), ways(spark)
    every = max(1, rows // SAMPLE_ROWS)
    sample = pieces.where(F.pmod(F.xxhash64("id", "h", "place"), F.lit(every)) == 0)
    least = max(16, min(rows, SAMPLE_ROWS) // parts)
    found = sample.groupBy("key").count().where(F.col("count") >= least).select("key")
    frequent = written(found, "line-frequent")  # ``parts`` keys at most, but for those of small tables

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first place of the key that the last batch ended with
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            rows = rows.combine_chunks()
            key = rows["key"].to_numpy()
            new = np.concatenate([[True], key[1:] != key[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            held = rows.slice(int(lead[-1]), 1)
            later = np.flatnonzero(~new)
            mine, theirs = rows.take(pa.array(later)), rows.take(pa.array(lead[later]))
            apart = np.ones(len(later), bool)
            for column in ("id", "h"):
                apart &= pc.equal(mine[column], theirs[column]).to_numpy()
            keep = pa.array(~apart)
            names = ["id", "h", "place", "weight"]
            columns = [mine.filter(keep)[c].combine_chunks() for c in names]
            columns += [theirs.filter(keep)[c].combine_chunks() for c in names[:3]]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "src", "src_h", "src_place"])

    schema = f"id {kind}, h long, place long, weight int, src {kind}, src_h long, src_place long"
    rare = pieces.join(F.broadcast(frequent), "key", "left_anti")
    usual = rare.repartition("key").sortWithinPartitions("key", "id", "h", "place").mapInArrow(run, schema)
    often = pieces.join(F.broadcast(frequent), "key", "left_semi")
    first = often.groupBy("key").agg(F.min(F.struct("id", "h", "place")).alias("f"))
    first = written(first.select("key", F.col("f.id").alias("src"), F.col("f.h").alias("src_h"), F.col("f.place").alias("src_place")), "line-first")
    joined = often.join(F.broadcast(first), "key").where("not (id <=> src and h = src_h)").drop("key")
    return usual.unionByName(joined)


def _ranges(links: DataFrame, kind: str) -> DataFrame:
    """The runs that go from each document, with the place in an earlier one that each end has:
    ``(id, h, begin, end, src, src_h, src_at, end_src, end_src_h, end_src_at)``."""

    def blocks_of(rows: pa.Table) -> tuple[list[tuple], np.ndarray]:
        rows = rows.combine_chunks()
        part = {c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in rows.column_names}
        begin, end = _halves(part["place"])
        at, at_end = _halves(part["src_place"])
        same = _same_as_before(part["id"]) & _same_as_before(part["h"])
        # Rows repeated with one id come once.
        once = ~(same & np.concatenate([[False], begin[1:] == begin[:-1]]))
        goes_on = same & _same_as_before(part["src"]) & _same_as_before(part["src_h"])
        if len(begin):
            goes_on[1:] &= (begin[1:] == end[:-1]) & ((at[1:] == at_end[:-1]) | (at[1:] == at[:-1]))
        if not once.all():
            keep = pa.array(once)
            return blocks_of(rows.filter(keep))
        lead = np.flatnonzero(~goes_on)
        tail = np.append(lead[1:], len(begin)) - 1
        weight = np.add.reduceat(part["weight"].to_numpy().astype(np.int64), lead) if len(lead) else lead
        take = pa.array(lead)
        ends = pa.array(tail)
        sources = list(zip(part["src"].take(take).to_pylist(), part["src_h"].take(take).to_pylist(), strict=True))
        docs = list(zip(part["id"].take(take).to_pylist(), part["h"].take(take).to_pylist(), strict=True))
        columns = [begin[lead].tolist(), end[tail].tolist(), sources, at[lead].tolist(), at_end[ends].tolist(), weight.tolist()]
        return list(zip(docs, zip(*columns, strict=True), strict=True)), same

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in [*batches_with_end(batches)]:
            rows = batch
            if held is not None:
                rows = held if batch is None else pa.concat_tables([held, batch])
            if rows is None:
                return
            if batch is None:
                held = None
            else:  # the last document may go on
                same = _same_as_before(rows["id"].combine_chunks()) & _same_as_before(rows["h"].combine_chunks())
                at = int(np.flatnonzero(~same)[-1]) if len(same) else 0
                held, rows = rows.slice(at), rows.slice(0, at)
            if not rows.num_rows:
                continue
            gone, current, mine = [], None, []
            for doc, block in [*blocks_of(rows)[0], (None, None)]:
                if doc != current and mine:
                    gone += [(*current, a[0], z[1], *a[2], a[3], *z[2], z[4]) for a, z in repeated_ranges(mine)]
                    mine = []
                current = doc
                mine.append(block)
            columns = list(zip(*gone, strict=True)) or [()] * 10
            id_type = rows.schema.field("id").type
            kinds = [id_type, *[pa.int64()] * 3, id_type, *[pa.int64()] * 2, id_type, *[pa.int64()] * 2]
            yield record(**{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    def batches_with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table | None]:
        for batch in batches:
            if batch.num_rows:
                yield pa.Table.from_batches([batch])
        yield None

    names = ["id", "h", "begin", "end", "src", "src_h", "src_at", "end_src", "end_src_h", "end_src_at"]
    types = [kind, "long", "long", "long", kind, "long", "long", kind, "long", "long"]
    near = links.repartition("id", "h").sortWithinPartitions("id", "h", "place")
    return near.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def _words_before(text: bytes) -> list[bytes]:
    return text.split()[::-1]


def _common_end(a: bytes, b: bytes) -> int:
    """Bytes that two runs without blanks have in common at their ends, in whole characters."""
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    while n and a[len(a) - n] & 0xC0 == 0x80:
        n -= 1
    return n


def _common_start(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    while n and n < len(a) and a[n] & 0xC0 == 0x80:
        n -= 1
    return n


def extended(text: bytes, begin: int, end: int, left: bytes | None, right: bytes | None) -> tuple[int, int]:
    """A range of ``text``, word by word as far as what stands beside it also stands beside the
    earlier copy; within runs that are long enough to count by characters, character by character.

    ``left`` and ``right`` are what the earlier document has before and after its copy.
    """
    mine = text[max(0, begin - NEAR_BYTES) : begin]
    glued = not mine[-1:].isspace() and not (left or b"")[-1:].isspace()
    if left:
        at = len(mine)
        for k, (a, b) in enumerate(zip(_words_before(mine), _words_before(left), strict=False)):
            place = mine.rfind(a, 0, at)
            cut = place == 0 and begin > NEAR_BYTES  # the word may be longer than what is seen of it
            if a == b and not cut and not (len(b) == len(left.lstrip()) >= NEAR_BYTES):
                at = place
                continue
            if (k == 0 and glued) or max(len(a), len(b)) >= LONG_RUN:
                at = place + len(a) - _common_end(a, b) if max(len(a), len(b)) >= LONG_RUN else at
            break
        begin -= len(mine) - at
    mine = text[end : end + NEAR_BYTES]
    if right:
        at = 0
        for a, b in zip(mine.split(), right.split(), strict=False):
            place = mine.find(a, at)
            cut = place + len(a) == len(mine) and end + NEAR_BYTES < len(text)
            if a == b and not cut and not (len(b) == len(right.rstrip()) >= NEAR_BYTES):
                at = place + len(a)
                continue
            if max(len(a), len(b)) >= LONG_RUN and (n := _common_start(a, b)):
                at = place + n
            break
        rest = mine[at:]
        if at:
            at += len(rest) - len(rest.lstrip())
        end += at
    return begin, end


def _near(docs: DataFrame, ranges: DataFrame, kind: str) -> DataFrame:
    """``(src, src_h, at, side, near)``: what stands before or after those places of earlier documents."""
    ends = ranges.select(F.explode(F.array(
        F.struct("src", "src_h", F.col("src_at").alias("at"), F.lit(0).alias("side")),
        F.struct(F.col("end_src").alias("src"), F.col("end_src_h").alias("src_h"), F.col("end_src_at").alias("at"), F.lit(1).alias("side")),
    )).alias("end")).select("end.*").distinct()
    asked = written(ends.groupBy("src", "src_h").agg(F.collect_list(F.struct("at", "side")).alias("ends")), "line-asked")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in small_batches(batches):
            at = texts.starts.tolist()
            rows = []
            for i, ends_of in enumerate(texts.rows.column("ends").to_pylist()):
                for end in ends_of:
                    place = at[i] + end["at"]
                    a, b = (place, min(at[i + 1], place + NEAR_BYTES)) if end["side"] else (max(at[i], place - NEAR_BYTES), place)
                    rows.append((i, end["at"], end["side"], texts.data[a:b].tobytes()))
            which, places, sides, near = zip(*rows, strict=True) if rows else ((), (), (), ())
            take = pa.array(which, pa.int64())
            yield record(
                src=texts.ids.take(take), src_h=texts.rows.column("h").take(take), at=pa.array(places, pa.int64()),
                side=pa.array(sides, pa.int32()), near=pa.array(near, pa.binary()),
            )

    keyed = asked.withColumnsRenamed({"src": "id", "src_h": "h"})
    some, _ = split_by_filter(docs, keyed, "id", "h")
    found = some.select("id", "h", "text").join(keyed, ["id", "h"])
    return written(found.mapInArrow(run, f"src {kind}, src_h long, at long, side int, near binary").distinct(), "line-near")


def _docs(docs: DataFrame, id_col: str, text_col: str, more: list[Column]) -> DataFrame:
    """``(id, h, text, *more)``; ``h`` tells texts of one id apart, and is 0 if every id is there once."""
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)
    again = frame.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count()
    return frame.withColumn("h", F.xxhash64("text") if again else F.lit(0).cast("long"))


def _gone(frame: DataFrame, kind: str) -> DataFrame:
    """``(id, h, gone)``: the byte ranges that go from each document that loses any."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in small_batches(batches):
            for shift, p in _cut(texts, SLICE_BYTES):
                take = pa.array(p.doc)
                begin, end = p.begin + shift[p.doc], p.end + shift[p.doc]
                yield record(
                    id=texts.ids.take(take), h=texts.rows.column("h").take(take), key=p.keys,
                    place=begin << 32 | end, weight=pa.array(p.weight, pa.int32()),
                )

    whole = frame.where("id is not null").select("id", "text", "h")
    pieces = written(whole.mapInArrow(cut, f"id {kind}, h long, key long, place long, weight int"), "line-pieces")
    ranges = written(_ranges(_links(pieces, kind), kind), "line-ranges")
    near = _near(whole, ranges, kind)
    left = near.where("side = 0").select("src", "src_h", F.col("at").alias("src_at"), F.col("near").alias("left"))
    right = near.where("side = 1").toDF("end_src", "end_src_h", "end_src_at", "side", "right").drop("side")
    known = ranges.join(left, ["src", "src_h", "src_at"], "left").join(right, ["end_src", "end_src_h", "end_src_at"], "left")
    return written(known.groupBy("id", "h").agg(F.collect_list(F.struct("begin", "end", "left", "right")).alias("gone")), "line-gone")


class Shortened:
    """What is left of some texts without the ranges in their rows' ``gone``."""

    def __init__(self, texts: Texts):
        self.text, self.n_words, self.n_removed, self.n_blocks = [], [], [], []
        nulls = texts.rows.column("text").is_null().to_pylist()
        word = ~_BLANK[texts.data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = texts.starts[:-1][np.diff(texts.starts) > 0]
        begins[inner] = word[inner]
        upto = np.concatenate([[0], np.cumsum(begins)])
        self.n_words = np.diff(upto[texts.starts])
        at = texts.starts.tolist()
        for i, ranges in enumerate(texts.rows.column("gone").to_pylist()):
            raw = texts.data[at[i] : at[i + 1]].tobytes()
            if not ranges:
                self._add(None if nulls[i] else raw, 0, 0)
                continue
            spans = sorted(extended(raw, r["begin"], r["end"], r["left"], r["right"]) for r in ranges)
            parts, place, blocks, removed = [], 0, 0, 0
            for begin, end in spans:
                if begin > place or not blocks:
                    blocks += 1
                    parts.append(raw[place:begin])
                if end > place:
                    removed += len(raw[max(begin, place) : end].split())
                    place = end
            parts.append(raw[place:])
            self._add(b"".join(parts), removed, blocks)

    def _add(self, text: bytes | None, removed: int, blocks: int) -> None:
        self.text.append(None if text is None else text.decode("utf-8", "replace"))
        self.n_removed.append(removed)
        self.n_blocks.append(blocks)


def _with_ranges(frame: DataFrame, kind: str) -> DataFrame:
    """``frame`` with ``gone``; only the texts of documents that lose something are shuffled."""
    gone = _gone(frame, kind)
    some, others = split_by_filter(frame, gone, "id", "h")
    joined = some.join(gone, ["id", "h"], "left")
    return joined.unionByName(others.withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(id_col, text, n_words, n_removed, n_blocks)``.

    ``text`` is what is left of the document. Lines, long ones in pieces, are looked up by
    hash. A document is aligned with each earlier one (smaller id) that is the first to have
    one of its lines: the rarest links there are, one per line and document, however many
    documents share the line. So no frequent line has to be left out, and no two documents
    are paired for a line that an earlier one has. Lines in a row on both sides are blocks.
    Patience diff aligns them; blocks of ``LEAST_BLOCK`` count wherever they stand in the
    two, also further copies within the later document. Runs of ``LEAST_WEIGHT`` or more of
    blocks that count go, if one of them is a long one, extended word by word as far as both
    documents agree. The first document that has a line always keeps it.

    ``n_words`` are words between blanks, ``n_removed`` those in what went, in ``n_blocks``
    ranges. A null text stays null, an empty one empty. Rows with a null id are not compared
    and stay as they are. Rows of one id and text are one document; those of one id and
    other texts are others, ordered by a hash. Of other columns none is looked at.
    """
    frame = _docs(docs, id_col, text_col, [])
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in small_batches(batches):
            left = Shortened(texts)
            yield record(
                id=texts.ids,
                text=pa.array(left.text, pa.string()),
                n_words=left.n_words,
                n_removed=pa.array(left.n_removed, pa.int64()),
                n_blocks=pa.array(left.n_blocks, pa.int64()),
            )

    schema = f"id {kind}, text string, n_words long, n_removed long, n_blocks long"
    left = _with_ranges(frame, kind).select("id", "text", "gone").mapInArrow(run, schema)
    return left.withColumnsRenamed({"id": id_col, "text": text_col})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns and what ``line_dedup`` leaves of the text.

    Documents of which nothing but blanks is left are dropped; those that had nothing before stay.
    """
    frame = _docs(docs, id_col, text_col, [F.struct("*").alias("row")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in small_batches(batches):
            left = Shortened(texts)
            kept = pa.array([not n or bool(t.strip()) for n, t in zip(left.n_removed, left.text, strict=True)], pa.bool_())
            rows = record(row=texts.rows.column("row"), text=pa.array(left.text, pa.string()))
            yield rows.filter(kept)

    kind = frame.schema["id"].dataType.simpleString()
    bare = frame.select("id", "h", "text", F.col("row").dropFields(text_col).alias("row")) if len(docs.columns) > 1 else frame
    found = _with_ranges(bare, kind).select("id", "text", "gone", "row")
    row = bare.schema["row"].dataType
    left = found.mapInArrow(run, f"row {row.simpleString()}, text string")
    mine = docs.schema[text_col].dataType
    return left.select(*[F.col("text").cast(mine).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
