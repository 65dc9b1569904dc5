"""The specification in plain Python, written from the survey."""

import math
import zlib
from collections import Counter


def keys(data, q):
    return [zlib.crc32(data[i : i + q]) for i in range(len(data) - q + 1)]


def minimizers(data, q, w, short):
    if len(data) < q:
        return {zlib.crc32(data)} if short == "self" else set()
    k = keys(data, q)
    return set(k) if len(k) <= w else {min(k[i : i + w]) for i in range(len(k) - w + 1)}


def rolling(data, window):
    out = []
    for p in range(len(data) - window + 1):
        h = 0
        for b in data[p : p + window]:
            h = (h * 257 + b) % 2**64
        out.append(h)
    return out


def entropy(data):
    return -sum(c / len(data) * math.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0


def bloom(crc, bits, k):
    low = crc * 0x9E3779B9 & 0xFFFFFFFF
    return {(low + i * crc) % bits for i in range(k)}


def search(q, post_b, masks, n, block, most=256):
    """(method, source, anchors, candidates) of one query's key set."""
    b = sorted((len(post_b[k]), k) for k in q if k in post_b)
    c = sorted((len(masks[k]) * block, k) for k in q if k in masks)
    total = len(b) + len(c)
    if not total:
        return "l0_fallback", "fallback", 0, set(range(n))
    cand, method, source, best = set(), "", "", None
    if b:
        best = b[0][0]
        cand = set(post_b[b[0][1]]) | (set(post_b[b[1][1]]) if len(b) > 1 else set())
        method, source = ("b_isect", "B_isect") if len(b) > 1 else ("b_best", "B")
        if len(cand) > most:
            cand, method = set(post_b[b[0][1]]), "b_best1"
    if c and (not b or len(cand) > most):
        two = {x for _, k in c[:2] for m in masks[k] for x in range(m * block, min(n, m * block + block))}
        if not b or c[0][0] < best:
            source, best = "C", c[0][0]
        if not cand or len(two) < len(cand):
            cand, method = two, "c_top2"
    if len(cand) > n // 2:
        cand, method, source = set(range(n)), "fallback", "fallback"
    near = {x for i in cand for x in (i - 1, i, i + 1) if 0 <= x < n}
    return f"l0_{method}_{total}", source, total, near
