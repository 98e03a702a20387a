"""The pre-tokenizing pattern as a small transducer that runs over many chunks at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import regex

from fleetlens.llm.common import Texts

CHUNK = 256  # symbols of a chunk
SLICE_BYTES = 2 << 20  # of a longer text, handled at once

# Classes of symbols: what the pattern's alternatives tell apart.
SPACE, BLANK, MARK, SHORT, RV, E, L, LETTER, NUMBER, OTHER, END = range(11)
CLASSES = 11

# States: what the symbols since the current piece's start are.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, AT_MARK, MARK_RV, MARK_L = range(9)
STATES = 9

# What a step says: a piece starts at this symbol, or (known only now) at the one before.
HERE, BEFORE = 1, 2


def _step(state: int, symbol: int) -> tuple[int, int]:
    if symbol == END:
        return FRESH, BEFORE if state in (MARK_RV, MARK_L) else 0
    letter = symbol in (SHORT, RV, E, L, LETTER)
    if state == MARK_RV or state == MARK_L:
        if symbol == (E if state == MARK_RV else L):
            return FRESH, 0
        after, says = _step(IN_LETTERS, symbol)
        return after, says | BEFORE
    if state == AT_MARK:
        if symbol == SHORT:
            return FRESH, 0
        if symbol == RV:
            return MARK_RV, 0
        if symbol == L:
            return MARK_L, 0
        state = IN_OTHERS
    if symbol in (SPACE, BLANK):
        run = state in (AFTER_SPACE, AFTER_BLANK)
        return AFTER_SPACE if symbol == SPACE else AFTER_BLANK, 0 if run else HERE
    kind = IN_LETTERS if letter else IN_NUMBERS if symbol == NUMBER else IN_OTHERS
    if state == AFTER_SPACE:  # the run's last space belongs to what follows
        return kind, BEFORE
    if state == kind:
        return kind, 0
    says = HERE | (BEFORE if state == AFTER_BLANK else 0)
    return (AT_MARK if symbol == MARK else kind), says


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state times CLASSES, and what the step says, at state times CLASSES plus class."""
    both = [_step(q, c) for q in range(STATES) for c in range(CLASSES)]
    return np.array([a * CLASSES for a, _ in both], np.uint8), np.array([b for _, b in both], np.uint8)


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    for pattern, name in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for run in regex.finditer(pattern, every):
            first, last = ord(run[0][0]), ord(run[0][-1])
            table[first : last + 1] = name
    table[0xD800:0xE000] = OTHER
    for name, symbols in ((SPACE, " "), (MARK, "'"), (SHORT, "stmd"), (RV, "rv"), (E, "e"), (L, "l")):
        table[[ord(x) for x in symbols]] = name
    return table


def slices(texts: Texts, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """``texts``, or one long text in parts with whole pieces in each.

    A part ends before a space with a letter after it and a visible ASCII character before
    it: no piece goes on there, as no alternative of the pattern takes blanks after others.
    A text that has no such place for long is not cut there.
    """
    data = texts.data
    if len(texts) != 1 or len(data) <= limit:
        yield texts
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data):
            part = data[at:end]
            before, letter = part[:-2], part[2:] | 0x20
            good = (part[1:-1] == 0x20) & (before > 0x20) & (before < 0x7F) & (letter >= 0x61) & (letter <= 0x7A)
            places = np.flatnonzero(good)
            if len(places):
                end = at + int(places[-1]) + 1
                break
            end = min(len(data), end + limit)
        yield Texts(texts.ids, data[at:end], np.array([0, end - at], np.int64), texts.rows)
        at = end


def valid(texts: Texts) -> tuple[np.ndarray, np.ndarray, str]:
    """Bytes, starts and the whole as text; what isn't UTF-8 becomes U+FFFD."""
    try:
        return texts.data, texts.starts, texts.data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        parts = [t.decode("utf-8", "replace").encode() for t in texts.each()]
        data = b"".join(parts)
        return np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, parts)]), data.decode()


def piece_starts(data: np.ndarray, starts: np.ndarray, text: str) -> np.ndarray:
    """Byte offsets in ``data`` where pieces start, in order; every non-empty text starts one.

    The symbols of all texts, with an end mark after each, are cut into chunks. First
    each chunk's state map is computed: for every state before it, the state after it.
    The maps are composed by a parallel prefix scan, which gives the state before each
    chunk, and then all chunks run again at once and say where pieces start.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    step, says = _tables()
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(points) == len(data):
        at = np.arange(len(data), dtype=np.int64)
        ends = starts[1:]
    else:
        sizes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        after = np.cumsum(sizes, dtype=np.int64)
        at = after - sizes
        ends = np.searchsorted(after, starts[1:], "right")
    symbols = np.insert(_classes()[points], ends, END)
    place = ends + np.arange(len(ends))  # of the end marks
    n = len(symbols)
    chunks = -(-n // CHUNK)
    rows = np.full(chunks * CHUNK, END, np.uint8)
    rows[:n] = symbols
    rows = np.ascontiguousarray(rows.reshape(chunks, CHUNK).T)

    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None] * np.uint8(CLASSES), chunks, axis=1)
    for row in rows:
        maps = step[maps + row]
    width = 1
    column = np.arange(chunks)
    while width < chunks:  # maps[:, c] becomes the map of all chunks up to c
        earlier = maps[:, :-width] // CLASSES
        composed = maps.copy()
        composed[:, width:] = maps[earlier, column[width:]]
        maps, width = composed, 2 * width
    state = np.concatenate([[np.uint8(FRESH * CLASSES)], maps[FRESH, :-1]])
    said = np.empty_like(rows)
    for row, out in zip(rows, said, strict=True):
        here = state + row
        out[:] = says[here]
        state = step[here]
    said = said.T.reshape(-1)[:n]
    mask = (said & HERE).astype(bool)
    mask[:-1] |= (said[1:] & BEFORE).astype(bool)
    mask = np.delete(mask, place)
    return at[mask]
