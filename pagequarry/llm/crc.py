"""CRC-32 of many byte strings at once, and of two joined ones from the CRCs of both.

The register is a linear map of its bits, so the CRC of ``a + b`` is that of ``a``
pushed through ``len(b)`` zero bytes, exclusive-or that of ``b``.
"""

import zlib

import numpy as np

_POLYNOMIAL = 0xEDB88320
#: Strings up to this length go by tables; longer ones one by one through zlib.
SHORT = 64


def _tables():
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)
    shift = np.empty((SHORT + 1, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(SHORT):
        shift[n + 1] = step[shift[n] & 255] ^ (shift[n] >> 8)
    return step, shift


STEP, SHIFT = _tables()


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start:end]``."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    size = end - start
    live = np.flatnonzero((size > 0) & (size <= SHORT))
    at, last, c = start[live], end[live], crc[live]
    while live.size:
        c = STEP[(c ^ data[at]) & 255] ^ (c >> 8)
        at = at + 1
        done = at == last
        if done.any():
            crc[live[done]] = c[done]
            live, at, last, c = live[~done], at[~done], last[~done], c[~done]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        crc[i] = zlib.crc32(data[start[i]:end[i]])
    return crc


def joined_by_space(a: np.ndarray, b: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``x + b' ' + y`` from the CRCs ``a`` of x and ``b`` of y, where y is ``data[start:end]``."""
    c = ~a
    c = ~(STEP[(c ^ 32) & 255] ^ (c >> 8))
    size = np.minimum(end - start, SHORT)
    out = b.copy()
    for k in range(4):
        out ^= SHIFT[size, k, (c >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(end - start > SHORT):
        out[i] = zlib.crc32(data[start[i]:end[i]], int(c[i]))
    return out
