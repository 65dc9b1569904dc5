"""Token counts by rank-synchronous merging of ragged numpy arrays.

The BPE vocabulary of a sentencepiece model is read from its file; the library itself is not used
to encode. A text becomes pre-tokens (blanks, then a word; no piece of the vocabulary crosses such
a border, which is checked when the model is read). All pre-tokens that a worker has not met yet
are merged together: their symbols lie in one flat array with row numbers, and in each round every
row applies its lowest-rank pair, at all places where that gives what the one-by-one order gives.
What survives is counted; a character outside the vocabulary counts as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
NONE = np.iinfo(np.int32).max
#: Begins the key of a pre-token that is taken as it is.
BARE = "\0"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _message(data: bytes) -> Iterable[tuple[int, int | bytes]]:
    """(field, value) of a serialised message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(path: str) -> dict[str, float]:
    """Piece to score, of the pieces that merging can make (normal ones)."""
    pieces, normal, trainer = {}, {}, {}
    with open(path, "rb") as f:
        for field, value in _message(f.read()):
            if field == 1:
                piece = dict(_message(value))
                if piece.get(3, 1) == 1:
                    pieces[piece[1].decode()] = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                elif piece[3] in (4, 5):
                    raise ValueError("user-defined and unused pieces are not handled")
            elif field == 2:
                trainer = dict(_message(value))
            elif field == 3:
                normal = dict(_message(value))
    if trainer.get(3, 1) != 2 or not trainer.get(35):
        raise ValueError("only BPE with byte fallback is handled")
    if normal.get(2) or normal.get(3, 1) != 1 or normal.get(4, 1) or normal.get(5, 1) != 1:
        raise ValueError("only the identity normaliser with a blank before the text is handled")
    return pieces


class Merger:
    """Merges pre-tokens by the ranks of a vocabulary."""

    def __init__(self, pieces: dict[str, float], keep: int = 600_000):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses the border before a blank")
        self.alone = frozenset("\n\r\t") - {c for p in pieces for c in p}
        breaks = re.escape("".join(self.alone))
        self.split = re.compile(f"{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+|[{breaks}]").findall
        order = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.id = {p: i for i, p in enumerate(pieces)}
        self.rank = np.array([order[s] for s in pieces.values()], np.int32)
        pairs = {}
        for whole, i in self.id.items():
            for k in range(1, len(whole)):
                a, b = self.id.get(whole[:k]), self.id.get(whole[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        # open addressing with linear probing, in arrays
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            left = self.keys[slot] != keys
            keys, values, slot = keys[left], values[left], slot[left] + 1 & self.mask
        self.keep, self.known = keep, {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1; a symbol outside the vocabulary is -1."""
        keys = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << 20 | b, np.int64(-2))
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            got = self.keys[slot]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (got >= 0)
            open_, slot = open_[go], slot[go] + 1 & self.mask
        return out

    def count(self, tokens: list[str]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        chars = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        distinct, back = self._distinct(chars)
        sym = np.array([self.id.get(chr(c), -1) for c in distinct], np.int32)[back] if len(chars) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(tokens)), lengths)
        size = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in distinct])[back] if len(chars) else np.zeros(0, np.int64)
        counts = np.bincount(row, np.where(sym < 0, size - 1, 0), len(tokens)).astype(np.int64)
        made = np.full(len(sym), -1, np.int32)  # what a symbol and the next one of its row make
        self._pair(made, sym, row, np.arange(len(sym)))
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            done = best == NONE
            if done.any():  # rows without a pair leave
                ends = row[starts[done]]
                counts[ends] += lengths[done]
                stay = np.repeat(~done, lengths)
                sym, row, made, rank, lengths, best = sym[stay], row[stay], made[stay], rank[stay], lengths[~done], best[~done]
                if not len(sym):
                    break
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
            low = np.repeat(best, lengths)
            at = np.flatnonzero(rank == low)
            # overlapping pairs: from the left, every second of a run
            run = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])])
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[nth % 2 == 0]
            if len(at) > len(starts):
                at = self._until_better(at, sym, row, made, low)
            sym[at] = made[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            place = at - np.arange(len(at))  # of the merged symbols, once those after them are gone
            sym, row, made = sym[left], row[left], made[left]
            changed = np.zeros(len(sym), bool)
            changed[place] = changed[np.maximum(place - 1, 0)] = True
            self._pair(made, sym, row, np.flatnonzero(changed))
        return counts

    @staticmethod
    def _distinct(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met = np.zeros(int(chars.max(initial=0)) + 1, bool)
        met[chars] = True
        return np.flatnonzero(met), (np.cumsum(met) - 1)[chars]

    def _pair(self, made, sym, row, at) -> None:
        last = len(sym) - 1
        made[at[at == last]] = -1
        at = at[at < last]
        inside = row[at] == row[at + 1]
        made[at] = np.where(inside, self.merged(sym[at], sym[at + 1]), -1)

    def _until_better(self, at, sym, row, made, low) -> np.ndarray:
        """Of each row's places, those up to the first whose merge makes a pair of the same or a lower rank."""
        new, n = made[at], len(sym)
        prior = np.r_[-1, at[:-1]]
        left_at = at - 1
        left = np.where(prior == at - 2, np.r_[-1, new[:-1]], sym[np.maximum(left_at, 0)])
        own = (left_at >= 0) & (row[np.maximum(left_at, 0)] == row[at])
        right_at = np.minimum(at + 2, n - 1)
        follows = (at + 2 < n) & (row[right_at] == row[at])
        a, b = self.merged(np.where(own, left, -1), new), self.merged(new, np.where(follows, sym[right_at], -1))
        bad = ((a >= 0) & (self.rank[a] <= low[at])) | ((b >= 0) & (self.rank[b] <= low[at]))
        rows = row[at]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        before = np.cumsum(bad) - bad
        return at[before - np.repeat(before[first], np.diff(np.r_[first, len(rows)])) == 0]

    def _tokens(self, text: str) -> list[str]:
        """Pre-tokens without their first mark; those that begin with a line end have none."""
        if "  " in text or text[0] == " " or MARK in text or BARE in text:
            return [BARE + x for x in self.split(MARK + text.replace(" ", MARK))]
        return text.replace("\n", " \n").split(" ")

    def _whole(self, key: str) -> str:
        return key[1:] if key[:1] == BARE else key if key[:1] == "\n" else MARK + key

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        known, out, fresh, late = self.known.get, [], {}, []
        for t in texts:
            found = list(map(known, keys := self._tokens(t) if t else ()))
            try:
                out.append(sum(found))
            except TypeError:  # some are new
                missing = [k for k, n in zip(keys, found) if n is None]
                fresh.update(dict.fromkeys(missing))
                late.append((len(out), missing))
                out.append(sum(filter(None, found)))
        fresh, new = list(fresh), {}
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            new.update(zip(part, self.count(list(map(self._whole, part))).tolist()))
        for i, missing in late:
            out[i] += sum(map(new.__getitem__, missing))
        if late and len(self.known) < self.keep:  # once full it stays: common pre-tokens come early
            self.known.update(new)
        return out


_MERGERS: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One merger a Python worker; what it has counted stays, up to a fixed number of pre-tokens."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(read_model(path))
    return _MERGERS[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; ``model`` is the vocabulary's file.

    A null text counts as empty (0 tokens); a null doc_id stays; repeated rows give repeated
    results; an empty table gives no rows. Further columns are left out. The file must be at the
    same place on every executor.
    """

    def run(batches):
        count = merger(model).texts
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            held, at, out = 0, 0, []
            for i, t in enumerate(texts):
                held += len(t)
                if held > 2 << 20:
                    out += count(texts[at : i + 1])
                    held, at = 0, i + 1
            out += count(texts[at:])
            n = pa.array(out, pa.int64())
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pa.array([x > limit for x in out], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
