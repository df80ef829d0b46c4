"""Words and their 64-bit hashes over UTF-8 bytes, in numpy."""

from __future__ import annotations

import numpy as np

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of lower-cased text: digits, letters, and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Masks that keep the first 0 to 8 bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of bytes in the class `inside`; runs never cross documents."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    w = inside[data]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's bytes as little-endian numbers of 8 bytes, zeros behind its end; and where each run's numbers begin, with the end."""
    n = (ends - starts + 7) >> 3
    at = np.concatenate([[0], np.cumsum(n)])
    place = np.repeat(starts - 8 * at[:-1], n) + 8 * np.arange(at[-1])
    lo = int(starts.min()) if len(starts) else 0
    room = np.concatenate([data[lo : int(ends.max()) if len(ends) else 0], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(room) - 7,), "<u8", room.data, strides=(1,))
    return eight[place - lo] & FIRST_BYTES[np.minimum(np.repeat(ends, n) - place, 8)], at


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each run's bytes; words are taken in blocks, so memory stays bounded for long texts.

    Every eight bytes enter with their place, whatever the length; words of up to eight bytes and one length never collide.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
        a, b = starts[at:to], ends[at:to]
        out[at:to] = chunk_hashes(*word_chunks(data, a, b), b - a)
        at = to
    return out


def chunk_hashes(chunks: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of runs, one or more, from what word_chunks() gives."""
    x = mixed(chunks)
    later = np.ones(len(x), bool)
    later[first[:-1]] = False
    later = np.flatnonzero(later)
    place = (later - first[np.searchsorted(first, later, "right") - 1]).astype(np.uint64)
    x[later] = mixed(x[later] + place * np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(x, first[:-1]) + lengths.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive words, one for each start; documents' ends are the caller's care."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0xFF51AFD7ED558CCD) + words[i : i + n]
    return mixed(h)
