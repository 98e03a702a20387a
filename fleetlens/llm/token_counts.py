"""Token counts: a BPE tokenizer compiled, as it is needed, into a transducer that counts."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.common import Texts, map_texts, record, slim
from fleetlens.llm.splitter import piece_starts, slices, valid

CHUNK = 512  # bytes of a chunk
MOST_STATES = 1 << 18  # states a worker holds; then it forgets them and starts over
MOST_PAIRS = 1 << 20  # remembered answers about pairs of tokens

UNKNOWN, START = 0, 1  # states: not yet known, and at a piece's first byte
GAIN_BITS, GAIN_ZERO = 8, 128


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _added(tokens: list[dict]) -> re.Pattern[bytes] | None:
    """Finds the vocabulary's added tokens, the longest of those that begin at one place."""
    for token in tokens:
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added token {token['content']!r} looks at its neighbours, which is not supported")
    contents = sorted((t["content"].encode() for t in tokens if t["content"]), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, contents))) if contents else None


class CountingTransducer:
    """Reads the bytes of a piece; each transition says by how much the token count changes.

    The state after some bytes is what the count's future depends on: for each place
    from which a token of the vocabulary may still go on, the node of the vocabulary's
    trie that the bytes since then lead to, the last token before the place, and how
    many tokens there were. The encoding of a longer prefix ends in the one token that
    ends there and may follow the last token before it, where two tokens may follow each
    other if their bytes together encode to just these two. Tokens are of bounded
    length, so there are finitely many states. They are made when first reached.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.added = _added(whole.get("added_tokens") or [])
        letters = _byte_letters()
        as_bytes = lambda text: bytes(letters[x] for x in text)
        self.tokens = {i: as_bytes(t) for t, i in model["vocab"].items() if all(x in letters for x in t)}
        ids = {t: i for i, t in self.tokens.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.single = [ids[bytes([b])] for b in range(256)]
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        self.goes_on = [False]
        for i, token in self.tokens.items():
            node = 0
            for b in token:
                child = self.trie.get(node << 8 | b)
                if child is None:
                    child = self.trie[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.goes_on.append(False)
                    self.goes_on[node] = True
                node = child
            self.ends[node] = i
        self.may: dict[tuple[int, int], bool] = {}
        self.width = 64  # columns of the table, one for each byte met so far
        self.column = np.zeros(256, np.int64)
        self.byte_of: list[int] = []
        self.forget()

    def forget(self) -> None:
        self.names = {(): UNKNOWN, ((0, -1, 0),): START}
        self.states: list[tuple] = [(), ((0, -1, 0),)]
        self.table = np.full((1 << 12) * self.width, -1, np.int32)
        self.table[: self.width] = UNKNOWN << GAIN_BITS | GAIN_ZERO

    def meet(self, data: np.ndarray) -> None:
        """Give each byte that is new a column."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if byte not in self.byte_of:
                self.column[byte] = len(self.byte_of)
                self.byte_of.append(byte)
        if len(self.byte_of) > self.width:
            self.width = min(256, 2 * len(self.byte_of))
            self.forget()

    def merge(self, parts: list[int]) -> list[int]:
        """The plain rule, for single bytes: join the neighbours of lowest rank, leftmost first."""
        merges = self.merges
        while len(parts) > 1:
            ranked = [(merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [merges[parts[i], parts[i + 1]][1]]
        return parts

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may come after ``last`` (-1: be first) in an encoding."""
        known = self.may.get((last, token))
        if known is None:
            before = [] if last < 0 else [last]
            raw = b"".join(self.tokens[t] for t in (*before, token))
            known = self.merge([self.single[b] for b in raw]) == [*before, token]
            if len(self.may) >= MOST_PAIRS:
                self.may.clear()
            self.may[last, token] = known
        return known

    def make(self, key: int) -> None:
        """The transition at ``key``, a state times ``width`` plus a byte's column."""
        byte, won, rest = self.byte_of[key % self.width], None, []
        for node, last, held in self.states[key // self.width]:  # the longest first
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            token = self.ends[child]
            if won is None and token >= 0 and self.follows(last, token):
                won = (token, held + 1)
            if self.goes_on[child]:
                rest.append((child, last, held))
        token, gain = won
        name = (*((node, last, held - gain) for node, last, held in rest), (0, token, 0))
        state = self.names.get(name)
        if state is None:
            state = self.names[name] = len(self.states)
            self.states.append(name)
            if state * self.width >= len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        self.table[key] = state << GAIN_BITS | (gain + GAIN_ZERO)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All transitions at once: states after, and changes of the counts."""
        keys = states * self.width + symbols
        to = self.table[keys]
        if to.min(initial=0) < 0:
            for key in np.unique(keys[to < 0]).tolist():
                self.make(key)
            to = self.table[keys]
        return to >> GAIN_BITS, (to & (1 << GAIN_BITS) - 1) - GAIN_ZERO

    def changes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """By how much each byte changes its piece's count; pieces begin at ``starts``.

        The bytes are cut into chunks. A chunk's state map is constant but for the bytes
        before its first piece start: whatever state comes in, the same one goes out. So
        all chunks run at once from an unknown state, which is known from the first piece
        start on. That composes the maps of chunks with a piece start, and their heads
        then run at once, each from the state that the chunk before hands on. A chunk
        inside one long piece waits for the chunk before it.
        """
        n = len(data)
        chunks = -(-n // CHUNK)
        padded = np.zeros(chunks * CHUNK, np.int64)
        padded[:n] = self.column[data]
        begins = np.zeros(chunks * CHUNK, bool)
        begins[starts] = True
        begins[n:] = True
        rows = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        flags = np.ascontiguousarray(begins.reshape(chunks, CHUNK).T)
        gains = np.zeros((CHUNK, chunks), np.int16)
        state = np.full(chunks, UNKNOWN, np.int64)
        for row, flag, gain in zip(rows, flags, gains, strict=True):
            state[flag] = START
            after, gain[:] = self.step(state, row)
            state = after.astype(np.int64)
        heads = np.where(flags.any(axis=0), flags.argmax(axis=0), CHUNK)
        out, waiting = state, np.flatnonzero(heads)
        while len(waiting):
            ready = waiting[out[waiting - 1] != UNKNOWN]
            ready = ready[np.argsort(-heads[ready], kind="stable")]
            state, sizes = out[ready - 1], heads[ready]
            for j in range(int(sizes[0])):
                live = int(np.searchsorted(-sizes, -j))  # those with more than j bytes before a start
                after, gains[j, ready[:live]] = self.step(state[:live], rows[j, ready[:live]])
                state[:live] = after
            inside = sizes == CHUNK
            out[ready[inside]] = state[inside]
            done = np.zeros(chunks, bool)
            done[ready] = True
            waiting = waiting[~done[waiting]]
        return gains.T.reshape(-1)[:n]

    def count_around_added(self, texts: Texts) -> np.ndarray:
        """Tokens of each text, in which an added token is one and cuts the text."""
        if self.added is None or not self.added.search(texts.data.tobytes()):
            return self.count(texts)
        inside, starts, owner = np.ones(len(texts.data), bool), [0], []
        found = np.zeros(len(texts), np.int64)
        for i, (begin, text) in enumerate(zip(texts.starts.tolist(), texts.each(), strict=False)):
            at = 0
            for match in self.added.finditer(text):
                found[i] += 1
                inside[begin + match.start() : begin + match.end()] = False
                starts.append(starts[-1] + match.start() - at)
                owner.append(i)
                at = match.end()
            starts.append(starts[-1] + len(text) - at)
            owner.append(i)
        parts = Texts(pa.array(owner), texts.data[inside], np.array(starts, np.int64), texts.rows)
        np.add.at(found, np.array(owner, np.int64), self.count(parts))
        return found

    def count(self, texts: Texts) -> np.ndarray:
        """Tokens of each text."""
        data, starts, text = valid(texts)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        if len(self.states) > MOST_STATES:
            self.forget()
        self.meet(data)
        upto = np.concatenate([[0], np.cumsum(self.changes(data, piece_starts(data, starts, text)), dtype=np.int64)])
        return upto[starts[1:]] - upto[starts[:-1]]


@cache
def transducer(path: str) -> CountingTransducer:
    """One for each worker process and vocabulary file, which every machine has."""
    return CountingTransducer(path)


def token_counts(
    docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` of each whole text.

    ``path`` is a byte-level BPE vocabulary in the JSON form of the tokenizers library,
    with its usual splitting of text. With ``added_tokens``, strings in a text that the
    vocabulary lists as added tokens are one token each, as by the library's default;
    otherwise they are plain text (its ``encode_special_tokens``). None is put around a
    text. Null and empty texts have none. Rows are handled one by one, so
    repeated rows come out repeated; other columns are not looked at.
    """

    def work(texts: Texts) -> pa.RecordBatch:
        made = transducer(path)
        count = made.count_around_added if added_tokens else made.count
        counts = sum(count(part) for part in slices(texts))
        return record(id=texts.ids, n_bytes=np.diff(texts.starts), n_tokens=counts, over_limit=counts > limit)

    frame = slim(docs, id_col, text_col)
    kind = frame.schema["id"].dataType.simpleString()
    return map_texts(frame, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean", work).withColumnRenamed("id", id_col)
