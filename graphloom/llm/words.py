"""Words of many texts as hashes, in numpy."""

from __future__ import annotations

import numpy as np

from .exchange import mix

#: Bytes that are hashed at once, as many as stay in a core's cache; a block ends behind a word.
BLOCK_BYTES = 256 << 10

_BASE = np.uint64(0xA0761D6478BD642F)
_SPACE = bytes(k in (9, 10, 11, 12, 13, 32) for k in range(256))
_LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and a 64-bit hash of every word with A-Z lower-cased, text after text.

    Words are runs of anything but ASCII white space. A hash is the sum of the bytes, each one more, times powers of a
    base, modulo 2**64, mixed with the word's length.
    """
    raw = b" ".join(texts) + b" "
    data, space = (np.frombuffer(raw.translate(t), np.uint8) for t in (_LOWER, _SPACE))
    edge = np.flatnonzero(np.diff(space, prepend=np.uint8(1)))
    first, end = edge[::2], edge[1::2]
    hashes, at, power, back = [np.empty(0, np.uint64)], 0, np.empty(0, np.uint64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(end, first[at] + BLOCK_BYTES, "right")))
            a, z = first[at:stop] - first[at], end[at:stop] - first[at]
            if len(power) < z[-1]:
                power, back = np.full(z[-1], _BASE, np.uint64), np.full(z[-1], pow(int(_BASE), -1, 1 << 64), np.uint64)
                power[0] = back[0] = 1
                np.multiply.accumulate(power, out=power)
                np.multiply.accumulate(back, out=back)
            sums = power[: z[-1]] * (data[first[at] : end[stop - 1]] + np.uint64(1))
            np.cumsum(sums, out=sums)
            total = sums[z - 1]
            total[1:] -= sums[a[1:] - 1]
            hashes.append(mix(total * back[a] + (z - a).astype(np.uint64)))
            at = stop
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return np.diff(np.searchsorted(first, ends), prepend=0), np.concatenate(hashes)
