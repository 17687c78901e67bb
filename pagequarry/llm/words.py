"""Words of a column of texts as flat numpy arrays: no Python object per word.

Used inside Arrow batches.  A batch is cut into chunks of a few MB, so the
arrays stay small whatever the batch size; a text is never cut.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes that end a word: ASCII white space, or all of ASCII but letters and digits.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Words:
    """Word ``k`` is ``data[start[k]:end[k]]``; text ``i`` has the words ``first[i]`` to ``first[i + 1]``."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self):
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h):
    """A permutation of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def find_words(texts: pa.Array, ends=SPACE, lower: bool = True) -> Words:
    """Words of each text, after lower-casing A-Z unless told otherwise; a null text has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[at[0]:at[-1]] if body is not None else np.zeros(0, np.uint8)
    bounds = at - at[0]
    data = np.zeros(len(raw) + 8, np.uint8)  # reads of eight bytes may pass the end
    data[:len(raw)] = _LOWER[raw] if lower else raw
    inside = ~ends[raw]
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | fresh[1:-1]
    start = np.flatnonzero(start)
    return Words(data, start, np.flatnonzero(end) + 1, np.searchsorted(start, bounds))


def hash_words(words: Words, seed: int = 0, prefix: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word, or of its first ``prefix`` bytes (at most 8)."""
    size = words.end - words.start
    if prefix is not None:
        size = np.minimum(size, prefix)
    lanes = np.ndarray((len(words.data) - 7,), "<u8", words.data, strides=(1,))
    h = mix(size.astype(np.uint64) + np.uint64(seed << 32 | 1))
    live, at, left = slice(None), words.start, size
    while left.size:
        h[live] = mix(h[live] ^ (lanes[at] & _MASKS[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, space: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``data[start:end]`` in a row, each followed by a space if asked for, and where each begins and ends."""
    size = end - start + space
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = data[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - start, size)]
    if space:
        out[bounds[1:] - 1] = 32
    return out, bounds


def chunks(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def texts_at(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, str]]:
    """Position and text of each row, null as empty, one Python string at a time."""
    for i, value in enumerate(batch.column(text)):
        yield i, value.as_py() or ""
