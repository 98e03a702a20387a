"""Byte-level BPE with a hierarchical-bitmap rank queue: encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.common import BATCH_BYTES, Texts, map_texts, record, slim
from fleetlens.llm.splitter import piece_starts, slices, valid

CACHE_ENTRIES = 1 << 17  # pre-tokens whose ids a worker remembers, and as many that it met before these
CACHED_BYTES = 64  # longer pre-tokens are encoded each time
LOOKED_UP = 1 << 16  # pre-tokens that are held at once
QUEUED_BYTES = 1 << 16  # of pre-tokens that are merged in one queue, or one longer pre-token


class RankQueue:
    """A priority queue of small whole numbers (merge ranks), each with a bucket of positions.

    Three levels of bitmaps with 64 bits to a word say which buckets are in use; finding
    the first set bit on each level gives the lowest rank in three steps, whatever the
    queue holds. Entries are never taken out when they go stale: the caller skips them.
    """

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def fill(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """``push`` of many at once into an empty queue; positions ascend."""
        order = np.argsort(ranks, kind="stable")
        used, first = np.unique(ranks[order], return_index=True)
        parts = positions[order].tolist()
        cuts = [*first.tolist(), len(parts)]
        for rank, a, b in zip(used.tolist(), cuts, cuts[1:], strict=False):
            self.push(rank, parts[a])
            self.buckets[rank] += parts[a + 1 : b]

    def pop_lowest(self) -> tuple[int, list[int]] | None:
        """The lowest rank and all its positions, which leave the queue."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = (a << 6) | ((word & -word).bit_length() - 1)
        word = self.low[b]
        rank = (b << 6) | ((word & -word).bit_length() - 1)
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Ranks of byte strings, which are also their ids; every single byte has one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(self.size)
        # The rank of what two tokens make, at the first's rank times size plus one, plus the second's.
        # One more number, size, stands for the end of a pre-token: nothing merges with it.
        self.pairs = {
            ranks[token[:cut]] * (self.size + 1) + ranks[token[cut:]]: rank
            for token, rank in ranks.items() for cut in range(1, len(token)) if token[:cut] in ranks and token[cut:] in ranks
        }
        singles = np.array([ranks.get(bytes([b]), self.size) for b in range(256)], np.int64)
        self.of_byte = np.append(singles, self.size)
        self.first = np.full((257, 257), -1, np.int64)  # ranks of two bytes; 256 is the end
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token: of all neighbours the pair of lowest rank merges, leftmost first.

        All of them go through one queue. Their merges don't touch each other, so each has its own in
        the order it would have alone; what has the same rank in several is taken out at once.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes + 1) - 1  # an end after each pre-token
        n = int(ends[-1]) + 1
        data = np.full(n, 256, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        data[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        found = np.append(self.first[data[:-1], data[1:]], -1)
        piece_of = np.repeat(np.arange(len(pieces)), sizes + 1).tolist()
        # A linked list of parts: token of the part at i, -1 where it is none any more, and its neighbours.
        tokens, merged = self.of_byte[data].tolist(), found.tolist()  # merged: rank of the pair that starts here, or -1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places = np.flatnonzero(found >= 0)
        self.queue.fill(found[places], places)
        buckets, push, get, across = self.queue.buckets, self.queue.push, self.pairs.get, self.size + 1
        while (lowest := self.queue.pop_lowest()) is not None:
            rank, same = lowest
            held = None  # pre-tokens where a pair now goes before the rest of this bucket
            for i in sorted(same) if len(same) > 1 else same:
                if merged[i] != rank:
                    continue  # stale
                if held is not None and piece_of[i] in held:
                    push(rank, i)
                    continue
                j = after[i]  # joins the part at i
                end = after[j]
                tokens[i], tokens[j] = rank, -1
                after[i], before[end] = end, i
                merged[j] = -1
                lower = False
                new = get(rank * across + tokens[end], -1)
                merged[i] = new
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        push(new, i)
                    lower = new <= rank
                left = before[i]
                if left >= 0:
                    new = get(tokens[left] * across + rank, -1)
                    merged[left] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            push(new, left)
                        lower = lower or new <= rank
                if lower:
                    held = held or set()
                    held.add(piece_of[i])
        ids = np.array(tokens, np.int64)
        kept = inside & (ids >= 0)
        packed = ids[kept].astype("<u4").tobytes()
        upto = (4 * np.cumsum(kept)[ends]).tolist()
        return [packed[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens one after the other, and where each token's bytes end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(total)], ends


class Encoder(dict):
    """Packed ids of each pre-token by its bytes, those met last; computes what it has not seen."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}
        self.whole = {token: rank.to_bytes(4, "little") for token, rank in vocabulary.ranks.items()}

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of different pre-tokens that are not remembered, and remembers them."""
        found, rest = {}, []
        for piece in pieces:
            known = self.whole.get(piece) or self.older.get(piece)
            if known is None:
                rest.append(piece)
            else:
                found[piece] = known
        for some in _grouped(rest):
            found.update(zip(some, self.vocabulary.encode_pieces(some), strict=True))
        for piece, packed in found.items():
            if len(piece) <= CACHED_BYTES:
                if len(self) >= CACHE_ENTRIES:  # what isn't met again goes the next time
                    self.older = dict(self)
                    self.clear()
                self[piece] = packed
        return found

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids start."""
        data, starts, text = valid(texts)
        cuts = piece_starts(data, starts, text)
        raw, places, packed = data.tobytes(), np.append(cuts, len(data)), []
        for at in range(0, len(cuts), LOOKED_UP):
            some = places[at : at + LOOKED_UP + 1].tolist()
            pieces = [raw[a:b] for a, b in zip(some, some[1:], strict=False)]
            known = list(map(self.get, pieces))
            missing = [i for i, ids in enumerate(known) if ids is None]
            found = self.learn(list(dict.fromkeys([pieces[i] for i in missing])))
            for i in missing:
                known[i] = found[pieces[i]]
            packed += known
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return np.frombuffer(b"".join(packed), "<u4"), upto[np.searchsorted(cuts, starts)]


def _grouped(pieces: list[bytes]) -> Iterator[list[bytes]]:
    """``pieces`` in groups of about ``QUEUED_BYTES``."""
    some, size = [], 0
    for piece in pieces:
        if some and size + len(piece) > QUEUED_BYTES:
            yield some
            some, size = [], 0
        some.append(piece)
        size += len(piece)
    if some:
        yield some


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file, which every machine has."""
    return Encoder(Vocabulary.read(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: the ids of each whole text, special strings read as ordinary text.

    ``path`` is a file of ranks, one base64 token and its rank to a line. Text is split
    by the pattern usual for such vocabularies, and each match is encoded for itself. A
    null or empty text has no ids. Rows are handled one by one, so repeated rows come out
    repeated; other columns are not looked at.
    """

    def work(texts: Texts) -> pa.RecordBatch:
        parts = [encoder(path).encode(part) for part in slices(texts)]
        ids = np.concatenate([ids for ids, _ in parts])
        starts = parts[0][1] if len(parts) == 1 else np.array([0, len(ids)])
        lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))
        return record(id=texts.ids, ids=lists)

    frame = slim(docs, id_col, text_col)
    kind = frame.schema["id"].dataType.simpleString()
    return map_texts(frame, f"id {kind}, ids array<int>", work).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, bytes)``: the bytes that the ids of each row stand for. Null ids give none."""

    def run(batches):
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            raw = [vocabulary.decode(np.array(ids or [], np.int64))[0].tobytes() for ids in batch.column("ids").to_pylist()]
            yield record(id=batch.column("id"), bytes=pa.array(raw, pa.binary()))

    frame = coded.selectExpr(f"`{id_col}` AS id", f"`{ids_col}` AS ids")
    kind = frame.schema["id"].dataType.simpleString()
    return frame.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens, ids_sha256, decoded_sha256)`` of each text encoded and decoded again.

    As ``encode`` and ``decode`` would give them, without sending ids through the JVM
    between the two: ids hash as little-endian unsigned 32-bit numbers. Null and empty
    texts have no tokens and the digests of nothing.
    """

    def digests(values: np.ndarray, cuts: list[int]) -> pa.Array:
        raw = memoryview(np.ascontiguousarray(values).view(np.uint8))
        return pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)], pa.string())

    def long(texts: Texts) -> pa.RecordBatch:
        known, n = encoder(path), 0
        coded, decoded = hashlib.sha256(), hashlib.sha256()
        for part in slices(texts):
            ids, _ = known.encode(part)
            n += len(ids)
            coded.update(np.ascontiguousarray(ids).tobytes())
            decoded.update(known.vocabulary.decode(ids)[0].tobytes())
        return record(id=texts.ids, n_tokens=[n], ids_sha256=[coded.hexdigest()], decoded_sha256=[decoded.hexdigest()])

    def work(texts: Texts) -> pa.RecordBatch:
        if len(texts) == 1 and len(texts.data) > BATCH_BYTES:
            return long(texts)
        known = encoder(path)
        ids, starts = known.encode(texts)
        back, ends = known.vocabulary.decode(ids)
        cuts = np.concatenate([[0], ends])[starts]
        return record(
            id=texts.ids,
            n_tokens=np.diff(starts),
            ids_sha256=digests(ids, (starts * 4).tolist()),
            decoded_sha256=digests(back, cuts.tolist()),
        )

    frame = slim(docs, id_col, text_col)
    kind = frame.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(frame, schema, work).withColumnRenamed("id", id_col)
