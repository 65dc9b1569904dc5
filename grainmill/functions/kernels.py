"""Byte kernels over numpy arrays: CRC grams, minimizers, rolling hash, entropy; and list codecs."""

from __future__ import annotations

import zlib

import numpy as np


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def _pair_tables(q: int) -> list[tuple[int, np.ndarray]]:
    """CRC-32 of q bytes is the complement of a XOR of what each byte adds by its place: (place, table) for two bytes
    at once, little-endian; of an odd q the last byte alone."""
    by_rest = [_TABLE]
    for _ in range(q - 1):
        by_rest.append(_TABLE[by_rest[-1] & 255] ^ by_rest[-1] >> 8)
    byte, pair = np.arange(256), np.arange(65536)
    one = [by_rest[q - 1 - k][byte ^ 255 if k < 4 else byte] for k in range(q)]
    if q < 4:  # the start value reaches beyond the data
        one[-1] = one[-1] ^ np.uint32(0xFFFFFFFF >> 8 * q)
    return [(k, one[k][pair & 255] ^ one[k + 1][pair >> 8] if k + 1 < q else one[k]) for k in range(0, q, 2)]


_PAIRS: dict[int, list[tuple[int, np.ndarray]]] = {}


def gram_crcs(data: np.ndarray, q: int) -> np.ndarray:
    """CRC-32 of every q-gram, as uint32; none if the data is shorter."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    if q not in _PAIRS:
        _PAIRS[q] = _pair_tables(q)
    pairs = data[:-1].astype(np.intp)
    pairs |= data[1:].astype(np.intp) << 8
    crc = np.zeros(n, np.uint32)
    for k, table in _PAIRS[q]:
        crc ^= np.take(table, (pairs if len(table) > 256 else data)[k : k + n])
    return np.bitwise_not(crc, out=crc)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling: log2(w) passes."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def minimizers(data: np.ndarray, q: int, w: int, short: str = "self") -> np.ndarray:
    """The distinct minimizer keys, sorted. Fewer than q bytes: the data's own key or none
    (``short`` is 'self' or 'empty'); at most w grams: all of them."""
    if len(data) < q:
        return np.array([zlib.crc32(data.tobytes())] if short == "self" else [], np.uint32)
    crc = gram_crcs(data, q)
    return distinct(crc if len(crc) <= w else changes(sliding_min(crc, w)))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted (numpy's unique() hashes integers first, which takes many times as long)."""
    return changes(np.sort(values))


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each is there."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return values[first], np.diff(first, append=len(values))


def changes(values: np.ndarray) -> np.ndarray:
    """The values without those that equal the one before."""
    return values[np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]])]


def minimizers_many(data: np.ndarray, ends: np.ndarray, q: int, w: int, short: str = "self", at_once: int = 1 << 17):
    """minimizers() of the values that lie end to end in ``data``, value i from ends[i] to ends[i + 1]: arrays (value,
    key), sorted, for some ``at_once`` bytes or one larger value at a time. Grams and windows over a border are left out."""
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + at_once, "right")) - 1)
        d, starts, sizes = data[ends[i] : ends[j]], ends[i:j] - ends[i], np.diff(ends[i : j + 1])
        crc, n = gram_crcs(d, q), sizes - q + 1
        found = []
        if len(crc) > w:
            least, wide = sliding_min(crc, w), n > w
            edge = np.zeros(len(crc) + 1, np.int8)
            np.add.at(edge, starts[wide], 1)
            np.add.at(edge, (starts + n - w + 1)[wide], -1)
            new = np.concatenate([[True], least[1:] != least[:-1]])
            new[starts[wide]] = True
            found.append(np.flatnonzero(new & (np.cumsum(edge[: len(least)], dtype=np.int8) > 0)))
            found.append(least[found[0]])
        few = np.flatnonzero((n > 0) & (n <= w))
        places = np.concatenate([np.zeros(0, np.int64), *(np.arange(starts[v], starts[v] + n[v]) for v in few)]).astype(np.int64)
        at = np.concatenate([found[0], places]) if found else places
        crcs = np.concatenate([found[1], crc[places]]) if found else crc[places]
        row = np.searchsorted(starts, at, "right") - 1
        if short == "self" and len(tiny := np.flatnonzero(sizes < q)):
            row = np.concatenate([row, tiny])
            crcs = np.concatenate([crcs, np.array([zlib.crc32(d[starts[v] : starts[v] + sizes[v]].tobytes()) for v in tiny], np.uint32)])
        key = distinct(row.astype(np.uint64) << np.uint64(32) | crcs)
        yield (key >> np.uint64(32)).astype(np.int64) + i, (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        i = j


def rolling_hashes(data: np.ndarray, window: int) -> np.ndarray:
    """Polynomial hash, base 257 modulo 2^64, of every window."""
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(window):
        out *= np.uint64(257)
        out += data[j : j + n]
    return out


def entropy(counts: np.ndarray) -> float:
    """Shannon entropy in bits; the terms are added in sorted order, so equal histograms agree."""
    c = np.sort(counts[counts > 0]).astype(np.float64)
    if not len(c):
        return 0.0
    p = c / c.sum()
    return abs(round(float(-(p * np.log2(p)).sum()), 9))


def bloom_places(crcs: np.ndarray, bits: int, k: int) -> np.ndarray:
    """A row of k bit positions for each key; ``bits`` is a power of two, so only crc modulo bits counts."""
    r = crcs.astype(np.uint64)
    return ((r * np.uint64(0x9E3779B9))[:, None] + r[:, None] * np.arange(k, dtype=np.uint64) & np.uint64(bits - 1)).astype(np.int64)


def runs_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of sizes[i] each, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def key64(crc: int) -> int:
    """The exported 64-bit key: a function of the CRC, with the same order."""
    return crc << 32 | crc * 0x9E3779B9 & 0xFFFFFFFF


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def put_deltas(ids: list[int]) -> bytes:
    """Count, then differences of the sorted ids, as varints."""
    return put_varint(len(ids)) + b"".join(put_varint(b - a) for a, b in zip([0, *ids], ids))


def get_deltas(data: bytes, at: int) -> tuple[list[int], int]:
    n, at = get_varint(data, at)
    ids, last = [], 0
    for _ in range(n):
        step, at = get_varint(data, at)
        last += step
        ids.append(last)
    return ids, at


def blocks_to_mask(blocks, mask_bytes: int) -> bytes:
    mask = bytearray(mask_bytes)
    for b in blocks:
        mask[b >> 3] |= 1 << (b & 7)
    return bytes(mask)


def mask_to_blocks(mask: bytes) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")).tolist()
