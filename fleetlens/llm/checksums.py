"""CRC-32C of many byte strings at once, and its masked form."""

from __future__ import annotations

from functools import cache

import numpy as np

# The Castagnoli polynomial, lowest bit first, and what masking adds.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

BLOCK = 64  # bytes that are handled as one column
_ALL = np.uint32(0xFFFFFFFF)


def _tables_of(images: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its images of each bit, as four tables by byte."""
    tables = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for bit in range(8):
        on = values >> bit & 1 == 1
        for byte in range(4):
            tables[byte, on] ^= images[8 * byte + bit]
    return tables


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@cache
def _past_zeros(power: int) -> np.ndarray:
    """The map of a checksum's state past two to the ``power`` zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power:
        half = _past_zeros(power - 1)
        return _tables_of(_apply(half, _apply(half, bits)))
    for _ in range(8):
        bits = bits >> 1 ^ np.where(bits & 1, np.uint32(POLYNOMIAL), np.uint32(0)).astype(np.uint32)
    return _tables_of(bits)


@cache
def _eight() -> list[np.ndarray]:
    """Tables for eight bytes at once: the first byte has seven more after it."""
    first = _past_zeros(0)[0]
    return [first] + [f for f in _further(first, 7)]


def _further(table: np.ndarray, n: int) -> list[np.ndarray]:
    out = []
    for _ in range(n):
        table = _apply(_past_zeros(0), table)
        out.append(table)
    return out


def _padded(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each string with zeros before it, which change nothing, so that it fills whole blocks."""
    out = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    ends = (np.cumsum(blocks) * BLOCK).tolist()
    at = starts.tolist()
    for a, b, end in zip(at, at[1:], ends, strict=False):
        out[end - (b - a) : end] = data[a:b]
    return out.reshape(-1, BLOCK)


def crc32c(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The CRC-32C of each ``data[starts[i]:starts[i + 1]]``.

    Blocks of all strings go side by side, eight bytes a step. Then the blocks of each
    string are joined in pairs, the earlier one moved past the later one's bytes, so that
    a long string takes as many rounds as the logarithm of its blocks.
    """
    sizes = np.diff(starts)
    counts = -(-sizes // BLOCK)
    table = _eight()
    rows = np.ascontiguousarray(_padded(data, starts, counts).T)
    state = np.zeros(rows.shape[1], np.uint32)
    for at in range(0, BLOCK, 8):
        new = table[7][rows[at] ^ (state & 255).astype(np.uint8)]
        for i in range(1, 4):
            new ^= table[7 - i][rows[at + i] ^ (state >> 8 * i & 255).astype(np.uint8)]
        for i in range(4, 8):
            new ^= table[7 - i][rows[at + i]]
        state = new
    power = BLOCK.bit_length() - 1
    left = counts.copy()
    while len(left) and left.max() > 1:
        whose = np.repeat(np.arange(len(left)), left)
        from_end = np.cumsum(left)[whose] - 1 - np.arange(len(whose))
        left = -(-left // 2)
        place = np.cumsum(left)[whose] - 1 - from_end // 2
        earlier = from_end % 2 == 1
        joined = np.zeros(int(left.sum()), np.uint32)
        joined[place[~earlier]] = state[~earlier]
        joined[place[earlier]] ^= _apply(_past_zeros(power), state[earlier])
        state, power = joined, power + 1
    out = np.zeros(len(sizes), np.uint32)
    out[counts > 0] = state
    begun = np.full(len(sizes), _ALL)  # what the start value becomes after all bytes
    for bit in range(int(sizes.max(initial=0)).bit_length()):
        on = sizes >> bit & 1 == 1
        begun[on] = _apply(_past_zeros(bit), begun[on])
    return out ^ begun ^ _ALL


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum fit to be stored among the bytes that further checksums are taken of."""
    with np.errstate(over="ignore"):
        return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)
