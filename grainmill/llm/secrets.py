"""Secret scans with a recursive decoding worklist.

Every whole text is scanned for the base kinds. Then a worklist unwraps what looks encoded:
percent-escapes, Unicode and hex escapes, base64 (also URL-safe, also over several lines, also of
UTF-16) and gzip, zlib, bzip2 and raw deflate streams inside it, and the former three in escaped bytes;
each layer again, until no layer is new. A layer with escapes gives one layer in which they are
replaced, and only a layer without any has its base64 unwrapped, each run once: as a whole, or, where
that gives nothing, in the parts between slashes, dashes, underscores and replaced escapes. So layers
do not multiply with the depth. Layers are known for the whole text by digests of their bytes and of
the places they came from, which ends cycles. Each layer keeps, for every character, where it came from
in the original text, so a secret found at any depth is reported as a span of the original.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
ENOUGH = {"assign": 6, "access": 20, "hex": 24}

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+")
ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
MIXED = re.compile(r"[0-9+/_=-]|[a-z][A-Z]")
#: Base64 of several lines, and the lines of it.
WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
PART = re.compile(r"[A-Za-z0-9+/_-]+")
#: What may stand beside base64 and is of its alphabet, as in paths.
SEAM = re.compile(r"[/_-]")
LEAST_BASE64 = 16
#: Percent- and backslash-escaped bytes from the head of a compressed stream on, plain ones between them.
QUOTED = re.compile(r"(?:%1[Ff]%8[Bb]|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|(?:BZh|%42%5[Aa]%68)(?:[1-9]|%3[1-9]))(?:%[0-9A-Fa-f]{2}|[!$&-.0-9:;=?@A-Z_a-z~/])*")
SLASHED = re.compile(r"(?:\\x1[Ff]\\x8[Bb]|(?:x|\\x78)(?:\\x01|\^|\\x5[Ee]|\\x9[Cc]|\\x[Dd][Aa])|(?:BZh|\\x42\\x5[Aa]\\x68)(?:[1-9]|\\x3[1-9]))(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"]|[ -\[\]-~])*")
BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'\"])|([ -~])")
NAMED = dict(zip("abfnrtv0\\'\"", b"\a\b\f\n\r\t\v\0\\'\""))
#: A compressed stream is unwrapped in layers of so many bytes, each with the end of the one before.
MOST_INFLATED, AGAIN = 64 << 20, 1 << 20
#: Bytes of a stream that are inflated at once: what comes before a broken place is kept up to these.
STEP = 16


@dataclass
class Layer:
    text: str
    start: np.ndarray | None  # per character, the span of the original it came from; None: itself
    end: np.ndarray | None
    joints: tuple = ()  # where replaced escapes begin and end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every base match, failing ones dropped."""
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= ENOUGH[kind]:
                yield kind, m.start(), m.end()


def _stream(raw: bytes):
    """A decompressor for what begins like a compressed stream."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] & 15 == 8 and int.from_bytes(raw[:2]) % 31 == 0):
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if raw[:3] == b"BZh" else None


def _inflated(raw: bytes, used: list[int]) -> Iterator[bytes]:
    """What the streams at the front of raw hold, one after the other, in blocks; as far as they can be read.

    used gets the number of bytes read and whether the first stream had its end.
    """
    at, whole = 0, False
    while (out := _stream(raw[at : at + 3])) is not None:
        got, begun = 0, at
        try:
            while at < len(raw) and not out.eof:
                step = raw[at : at + STEP]
                at += len(step)
                block = out.decompress(step, MOST_INFLATED)
                while block:
                    got += len(block)
                    yield block
                    if out.eof:
                        break
                    block = out.decompress(out.unconsumed_tail if hasattr(out, "unconsumed_tail") else b"", MOST_INFLATED)
        except (zlib.error, OSError, ValueError, EOFError):
            if not got:
                at = begun
            break
        if not out.eof:
            break
        whole = True
        at -= len(out.unused_data)
    used[:] = [at, whole]


def _layers(raw: bytes, used: list[int]) -> Iterator[str]:
    """The texts in compressed streams, in layers of MOST_INFLATED bytes that share AGAIN bytes."""
    decoder, held = codecs.getincrementaldecoder("utf-8")("surrogateescape"), ""
    parts, size = [], 0
    for block in _inflated(raw, used):
        parts.append(decoder.decode(block))
        size += len(block)
        if size >= MOST_INFLATED:
            text = held + "".join(parts)
            held, parts, size = text[-AGAIN:], [], 0
            if _readable(text):
                yield text
    if parts and _readable(text := held + "".join(parts)):
        yield text


def _readable(text: str) -> bool:
    return sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.95 * len(text) > 0


def _as_text(raw: bytes) -> tuple[str, np.ndarray] | None:
    """The text, and for each character its first byte; and one more for the end."""
    wide = len(raw) >= 8 and len(raw) % 2 == 0 and max((raw[1::2].count(0), "utf-16-le"), (raw[::2].count(0), "utf-16-be"))
    try:
        if wide and wide[0] * 2 >= len(raw) // 2:
            text = raw.decode(wide[1])
            return (text, _owner([2 if c < "\U00010000" else 4 for c in text])) if _readable(text.lstrip("\ufeff")) else None
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return (text, np.arange(len(text) + 1) if text.isascii() else _owner([len(c.encode()) for c in text])) if _readable(text) else None


def _owner(widths: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(widths, np.int64))])


Piece = tuple[int, int, str, np.ndarray, np.ndarray]


def _escapes(text: str) -> Iterator[Piece]:
    """(start, end, decoded, starts, ends) of escapes; spans are in the text."""
    if "%" in text:
        for m in PERCENT.finditer(text):
            if (got := _as_text(bytes.fromhex(m[0].replace("%", "")))) is not None:
                at = m.start() + 3 * got[1]
                yield m.start(), m.end(), got[0], at[:-1], at[1:]
    if "\\" in text or "&#" in text:
        for m in ESCAPE.finditer(text):
            out, units = [], []
            for x in ONE.finditer(m[0]):
                code = int(next(g for g in x.groups() if g), 10 if x[5] else 16)
                if code > 0x10FFFF:
                    break
                out.append(code)
                units.append((m.start() + x.start(), m.start() + x.end()))
            else:
                chars, spans = [], []
                for code, span in zip(out, units):
                    if chars and 0xDC00 <= code < 0xE000 and 0xD800 <= chars[-1] < 0xDC00:  # a pair of surrogates
                        chars[-1] = 0x10000 + ((chars[-1] - 0xD800) << 10) + code - 0xDC00
                        spans[-1] = (spans[-1][0], span[1])
                    else:
                        chars.append(code)
                        spans.append(span)
                got = "".join(map(chr, chars))
                if not any(0xD800 <= c < 0xE000 for c in chars):
                    at = np.array(spans)
                    yield m.start(), m.end(), got, at[:, 0], at[:, 1]


def _quoted(text: str) -> Iterator[Piece]:
    """What compressed streams in escaped bytes hold."""
    for pattern, sign in ((QUOTED, "%"), (SLASHED, "\\")):
        for m in pattern.finditer(text) if sign in text else ():
            raw, ends = bytearray(), []
            for x in BYTE.finditer(m[0]):
                raw.append(int(x[1] or x[2], 16) if x[1] or x[2] else NAMED[x[3]] if x[3] else ord(x[4]))
                ends.append(m.start() + x.end())
            used = []
            for got in _layers(bytes(raw), used):
                # how far the stream goes is known at its end; a layer names the whole run till then
                end = ends[used[0] - 1] if used else m.end()
                yield m.start(), end, got, *_all(got, m.start(), end)


def _encoded(text: str, joints: tuple) -> Iterator[Piece]:
    """What base64 holds; a run is unwrapped once."""
    done = []
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            lines = [(m.start() + x.start(), m.start() + x.end()) for x in PART.finditer(m[0])]
            for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)):  # the first or last line may be other text
                part = lines[a : len(lines) - b]
                if len(part) > 1:
                    found = list(_in_base64("".join(text[x:y] for x, y in part), np.concatenate([np.arange(x, y) for x, y in part]), part[-1][1]))
                    yield from found
                    if found:
                        done.append((part[0][0], part[-1][1]))
                        break
    for m in BASE64.finditer(text):
        while done and done[0][1] <= m.start():
            done.pop(0)
        if done and done[0][0] <= m.start():
            continue
        body = m[0].rstrip("=")
        found = list(_in_base64(body, np.arange(m.start(), m.end()), m.end()))
        yield from found
        if not found and MIXED.search(body):
            last = m.start() + len(body)
            seams = {m.start() + x.end() for x in SEAM.finditer(body)} | {m.start() + x.start() for x in SEAM.finditer(body)}
            cuts = sorted({m.start(), last} | seams | {j for j in joints[bisect_left(joints, m.start()) : bisect_right(joints, last)]})
            for a, b in zip(cuts, cuts[1:]):
                if LEAST_BASE64 <= b - a < len(body):
                    yield from _in_base64(text[a:b], np.arange(a, b), b)


def _all(got: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Every character comes from the whole stream."""
    return np.broadcast_to(np.int64(a), len(got)), np.broadcast_to(np.int64(b), len(got))


def _in_base64(body: str, at: np.ndarray, end: int) -> Iterator[Piece]:
    """What the base64 body holds whose characters are at these places of the text."""
    if not MIXED.search(body) or len(body) % 4 == 1:
        return
    try:
        raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    a, used = int(at[0]), []
    for got in _layers(raw, used):
        yield a, end, got, *_all(got, a, end)
    if used[1]:
        return
    if (got := _as_text(raw)) is not None:
        own = got[1]
        first, last = own[:-1] // 3 * 4 + own[:-1] % 3, np.minimum((own[1:] - 1) // 3 * 4 + (own[1:] - 1) % 3 + 1, len(body) - 1)
        yield a, end, got[0], at[first], at[last] + 1
    elif not used[0] and (got := _deflated(raw)) is not None:
        yield a, end, got, *_all(got, a, end)


def _deflated(raw: bytes) -> str | None:
    """The text of a raw deflate stream that ends where the bytes end. It has no head to be known by, so
    one beyond MOST_INFLATED is taken for chance."""
    out = zlib.decompressobj(-15)
    try:
        got = out.decompress(raw, MOST_INFLATED)
    except zlib.error:
        return None
    found = _as_text(got) if out.eof and not out.unused_data and len(got) >= 8 else None
    return found and found[0]


def _unwrapped(layer: Layer) -> Iterator[Layer]:
    """Percent- and character-escapes are replaced in place; what streams and base64 hold is a layer of its own."""
    text, n = layer.text, len(layer.text)
    start = np.arange(n) if layer.start is None else layer.start
    end = np.arange(1, n + 1) if layer.end is None else layer.end

    def mapped(first, last):
        if len(first) and first.strides == last.strides == (0,):
            return np.broadcast_to(start[first[0] : last[0]].min(), len(first)), np.broadcast_to(end[first[0] : last[0]].max(), len(first))
        if not len(first):
            return first, last
        # the smallest start and largest end of each character's places; reduceat takes pairs of bounds
        bounds = np.stack([first, last], 1).ravel()
        return np.minimum.reduceat(np.append(start, n_far), bounds)[::2], np.maximum.reduceat(np.append(end, -1), bounds)[::2]

    n_far = np.iinfo(np.int64).max
    taken = []
    for a, b, got, first, last in _quoted(text):
        taken.append((a, b))
        yield Layer(got, *mapped(first, last))
    places = [p for p in _escapes(text) if not any(a < p[1] and p[0] < b for a, b in taken)]
    if not places:
        for _, _, got, first, last in _encoded(text, layer.joints):
            yield Layer(got, *mapped(first, last))
        return
    texts, starts, ends, at, length, joints = [], [], [], 0, 0, []
    for a, b, got, first, last in sorted(places, key=lambda p: p[0]):
        if a < at:
            continue
        s, e = mapped(first, last)
        texts += [text[at:a], got]
        starts += [start[at:a], s]
        ends += [end[at:a], e]
        joints += [length + a - at, length + a - at + len(got)]
        length += a - at + len(got)
        at = b
    texts.append(text[at:])
    yield Layer("".join(texts), np.concatenate([*starts, start[at:]]), np.concatenate([*ends, end[at:]]), tuple(joints))


def _known(layer: Layer) -> bytes:
    """A digest of the layer's bytes and places."""
    out = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16)
    for x in (layer.start, layer.end):
        if x is not None:
            out.update(x[:1].tobytes() if x.strides == (0,) else np.ascontiguousarray(x).tobytes())
    return out.digest()


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, as (start, kind's number, end)."""
    number = {k: i for i, k in enumerate(KINDS)}
    base = sorted((a, number[k], b) for k, a, b in matches(text))
    met, found, work = set(), set(base), [_unwrapped(Layer(text, None, None))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
        elif (key := _known(layer)) not in met:
            met.add(key)
            for kind, a, b in matches(layer.text):
                a, b = layer.span(a, b)
                found.add((a, number[kind], b))
            work.append(_unwrapped(layer))
    return base, sorted(found)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts by kind, base_sha256 and spans (kind:start:end in code points).

    A null text counts as empty: no spans, and the digest of an empty string. A null doc_id stays
    null; repeated rows give repeated results; equal spans found in two layers count once; an empty
    table gives no rows. Further columns are left out.
    """
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, every = scan(text or "")
                counts = [sum(x[1] == k for x in base) for k in range(3)]
                rows.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
