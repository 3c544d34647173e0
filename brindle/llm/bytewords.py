"""Vectorised words of UTF-8 text, for use inside Arrow batches.

Every word definition of this subpackage separates words by ASCII bytes only, so a
batch of texts is scanned as one byte buffer with numpy: no Python object per word.
A word's hash sums up its 8-byte blocks, each mixed under a key of its place; a window's
hash is a polynomial in its words' hashes.  All hashes depend on the text and SEED alone.
(Polynomials in the bytes modulo 2**64 won't do for words of any length: Thue-Morse words
have equal values, whatever the factor.)
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEED = 0x9E3779B97F4A7C15  # of the keys; another one makes other hashes
_Q = np.uint64(0xD6E8FEB86659FD93)
_LONG = 128  # bytes from which a span is hashed on its own
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(n: int, first: int = 0) -> np.ndarray:
    """Keys of n blocks of a span, from block `first` on."""
    return mix(np.arange(first, first + n, dtype=np.uint64) * _Q + np.uint64(SEED))


def class_table(separators: bytes) -> np.ndarray:
    """256 flags: True for bytes that separate words."""
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACE = class_table(b" \t\n\x0b\x0c\r")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
PUNCT = class_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Texts:
    """Texts as one buffer: text i is buf[offset[i]:offset[i + 1]]."""

    buf: np.ndarray
    offset: np.ndarray

    def __len__(self) -> int:
        return len(self.offset) - 1

    def lower(self) -> Texts:
        return Texts(_LOWER[self.buf], self.offset)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The buffer of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(buf, off - off[0])


@dataclass
class Words:
    """Words of all texts in order: bytes start:end of the buffer; those of text i are first[i]:first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        """Of each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def place(self) -> np.ndarray:
        """Of each word, its place in its text."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))


def find_words(t: Texts, table: np.ndarray) -> Words:
    n = len(t.buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(t) + 1, np.int64))
    inside = ~table[t.buf]
    edge = np.empty(n, bool)
    edge[0] = inside[0]
    edge[1:] = inside[1:] & ~inside[:-1]
    cut = t.offset[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    edge[cut] = inside[cut]  # a word doesn't run over the end of its text
    start = np.flatnonzero(edge)
    stop = np.empty(n, bool)
    stop[-1] = inside[-1]
    stop[:-1] = inside[:-1] & ~inside[1:]
    stop[cut - 1] = inside[cut - 1]
    end = np.flatnonzero(stop) + 1
    return Words(start, end, np.searchsorted(start, t.offset))


def unicode_space(buf: np.ndarray) -> np.ndarray:
    """Flags of the bytes of white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000."""
    out = np.zeros(len(buf), bool)
    high = np.flatnonzero(buf >= 0xC2)
    one, two = (np.r_[buf, 0, 0][high + k] for k in (1, 2))
    lead = buf[high]
    pair = high[(lead == 0xC2) & ((one == 0x85) | (one == 0xA0))]
    spaces = (lead == 0xE1) & (one == 0x9A) & (two == 0x80)
    spaces |= (lead == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    spaces |= (lead == 0xE2) & (one == 0x81) & (two == 0x9F)
    spaces |= (lead == 0xE3) & (one == 0x80) & (two == 0x80)
    triple = high[spaces]
    for at, size in ((pair, 2), (triple, 3)):
        for k in range(size):
            out[at + k] = True
    return out


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]."""
    size = np.asarray(end - start)
    out = np.zeros(len(size), np.uint64)
    if not len(size):
        return out
    keys = _keys(_LONG // 8)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    some = np.flatnonzero(size < _LONG)
    for k in range(_LONG // 8):
        some = some[size[some] > 8 * k]
        if not len(some):
            break
        out[some] += mix((blocks[start[some] + 8 * k] & _MASKS[np.minimum(size[some] - 8 * k, 8)]) ^ keys[k])
    for i in np.flatnonzero(size >= _LONG).tolist():
        for at in range(0, int(size[i]), 1 << 20):
            span = buf[start[i] + at : min(start[i] + at + (1 << 20), end[i])]
            whole = np.zeros(-(-len(span) // 8) * 8, np.uint8)
            whole[: len(span)] = span
            out[i : i + 1] += mix(whole.view("<u8") ^ _keys(len(whole) // 8, at // 8)).sum(keepdims=True)
    return mix(out ^ (size.astype(np.uint64) * _Q))


def window_hashes(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of each `size` consecutive values of h; those that cross texts are up to the caller to leave out."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64((0xA0761D6478BD642F + 2 * seed * 0xE7037ED1A0B428DB) & ((1 << 64) - 1) | 1)
    for k in range(size):
        out *= factor
        out += h[k : k + n]
    return mix(out + np.uint64(seed))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Places in the word sequence at which a window lies within one text."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(left >= size)


def words_hashed(column, table: np.ndarray, lower: bool = False) -> tuple[Texts, Words, np.ndarray]:
    t = texts_of(column)
    t = t.lower() if lower else t
    w = find_words(t, table)
    return t, w, hash_spans(t.buf, w.start, w.end)


def in_pieces(batches, column: str = "text", at_most: int = 8 << 20):
    """Arrow record batches as tables of about `at_most` bytes of text, so memory doesn't follow Spark's batch size; a longer text has a table of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.diff(texts_of(batch.column(batch.schema.get_field_index(column))).offset))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + at_most, "right")))
            yield pa.Table.from_batches([batch.slice(at, to - at)])
            at = to


def coverage(starts: np.ndarray, size, n: int) -> np.ndarray:
    """Flags of n places that spans starts:starts + size cover."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + size, n), -1)
    return np.cumsum(d[:-1]) > 0
