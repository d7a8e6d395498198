"""Word hashes of whole columns of texts at once, without an object for each word.

Bytes are looked at in stretches of bounded size, cut between documents or, within a long one, at white space. A word's hash reads
eight bytes at a time through one overlapping view of the stretch; words over WIDE bytes take XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of a stretch, about; bytes of a word from which on it is hashed by itself.
STRETCH, WIDE = 1 << 18, 256
#: What stands for a text's end, and precedes the first word: the hash of a line feed, which no word holds.
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))
#: The lowest 0 to 8 bytes of a number.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return data | (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)


def is_solid(data: np.ndarray) -> np.ndarray:
    """Which bytes are not white space: tab to carriage return, and blank."""
    return (data - np.uint8(9) > 4) & (data != 32)


def finished(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on every other."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word data[start:end]; words of up to eight bytes collide only with longer ones or across lengths."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    h = finished((lanes[start] & MASK[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows, at = np.nonzero((length > 8) & (length <= WIDE))[0], 8
    while len(rows):
        rest = length[rows] - at
        h[rows] = finished((h[rows] << np.uint64(1)) + h[rows] + (lanes[start[rows] + at] & MASK[np.minimum(rest, 8)]))
        rows, at = rows[rest > 8], at + 8
    for k in np.nonzero(length > WIDE)[0].tolist():
        h[k] = xxhash.xxh64_intdigest(data[start[k] : end[k]])
    return h


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and the last ends; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, dtype=np.uint8)), offsets


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first row, row behind the last, first byte, byte behind the last, whether the last row ends here)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        behind = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STRETCH, "right")) - 1)
        a, b = int(offsets[row]), int(offsets[behind])
        while b - a > STRETCH:  # one long text: cut before the first white space from there on
            cut = a + STRETCH
            while cut < b and not len(ahead := np.nonzero(~is_solid(data[cut : min(b, cut + 4096)]))[0]):
                cut += 4096
            if cut >= b:
                break
            cut += int(ahead[0])
            yield row, row + 1, a, cut, False
            a = cut
        yield row, behind, a, b, True
        row = behind


def token_stream(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the tokens of a column, a stretch at a time, in order: the words of each text in lower case (A-Z), then END.

    A word is a maximal run of bytes other than ASCII white space. Null and empty texts are END alone."""
    data, offsets = _flat(column)
    for row, behind, a, b, ended in _pieces(data, offsets):
        own = lowered(data[a:b])
        solid = is_solid(own)
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:]
        inner = offsets[row + 1 : behind] - a  # where one text meets the next
        inner = inner[(inner > 0) & (inner < len(own))]
        begin[inner] = solid[inner]
        stop[inner - 1] = solid[inner - 1]
        start, end = np.nonzero(begin)[0], np.nonzero(stop)[0] + 1
        doc = np.searchsorted(offsets[row + 1 : behind] - a, start, "right")
        ends = np.arange(behind - row if ended else 0)
        hashes = np.empty(len(start) + len(ends), dtype=np.uint64)
        rows = np.empty(len(hashes), dtype=np.int64)
        at = np.arange(len(start)) + doc
        hashes[at], rows[at] = word_hashes(own, start, end), doc + row
        last = np.searchsorted(doc, ends, "right") + ends
        hashes[last], rows[last] = END, ends + row
        yield rows, hashes
