"""Pieces of texts and their ids: the splitting that byte-level tokenizers do first, over whole batches at a time.

Texts become one array of code points; where a piece begins follows from the kinds of neighbouring code points
(letter, number, white space, other), so a batch is split by a handful of numpy passes. The kind of a code
point is learnt from the tokenizer's own splitter the first time it is met, so both use the same Unicode tables.
Equal pieces of a batch are made one by Arrow; ids of pieces are remembered from batch to batch, up to a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa

#: The pattern whose pieces are found without a regular expression engine; for others the engine's are taken.
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE, UNSEEN = range(5)
#: Characters of text that are split at a time.
AT_ONCE = 1 << 22


class Pieces:
    """split(text) gives a text's pieces in order; learn(pieces) gives the ids of each of some pieces."""

    def __init__(self, split: Callable[[str], list[str]], learn: Callable[[list[str]], Iterable], runs: bool = True, bound: int = 1_000_000):
        self.split, self.learn, self.runs, self.bound = split, learn, runs, bound
        self.kinds = np.full(0x110000, UNSEEN, np.uint8)
        self.forget()

    def forget(self) -> None:
        """Give back what is remembered."""
        self.rows: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _kind(self, c: str) -> int:
        """What c continues: a run of letters, of numbers, of others; else it is white space."""
        return next((k for k, x in enumerate("a1!") if len(self.split(x + c)) == 1), SPACE)

    def begins(self, points: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each code point; doc marks the first one of each text."""
        kind = self.kinds[points]
        if (kind == UNSEEN).any():
            for c in np.unique(points[kind == UNSEEN]).tolist():
                self.kinds[c] = self._kind(chr(c))
            kind = self.kinds[points]
        space = kind == SPACE
        out = np.ones(len(points), bool)
        if not len(points):
            return out
        # a change of kind begins a piece, but a blank goes with what follows it
        out[1:] = kind[1:] != kind[:-1]
        out[1:] &= space[1:] | (points[:-1] != 32)
        # of several white spaces the last one before a word stands apart
        last = np.flatnonzero(space[1:-1] & space[:-2] & ~space[2:] & ~doc[2:]) + 1
        out[last] = True
        out |= doc
        # endings after an apostrophe that begins a piece
        at = np.flatnonzero((points[:-1] == 39) & out[:-1] & ~doc[1:])
        if len(at):
            one = points[at + 1]
            two = np.where(at + 2 < len(points), points[np.minimum(at + 2, len(points) - 1)], 0)
            two[(at + 2 < len(points)) & doc[np.minimum(at + 2, len(points) - 1)]] = 0
            n = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
            for a, b in ("re", "ve", "ll"):
                n[(one == ord(a)) & (two == ord(b))] = 2
            at, n = at[n > 0], n[n > 0]
            out[at + 1] = False
            ends = at + 1 + n
            out[ends[ends < len(points)]] = True
        return out

    def pieces(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """All pieces of texts (no nulls), and how many pieces stand before each text and before the end."""
        if not self.runs:
            each = [self.split(t) for t in texts.to_pylist()]
            return pa.array([p for x in each for p in x], pa.string()), np.cumsum([0, *map(len, each)])
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        if low == high:
            return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
        data = texts.buffers()[2].slice(low, high - low)
        raw = np.frombuffer(data, np.uint8)
        leads = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(data.to_pybytes().decode().encode("utf-32-le"), np.uint32)
        doc = np.zeros(len(points) + 1, bool)
        starts = offsets.astype(np.int64) - low
        doc[np.searchsorted(leads, starts)] = True
        at = leads[self.begins(points, doc[:-1])]
        edges = np.append(at, high - low).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(edges), data), np.searchsorted(at, starts)

    def _row(self, pieces: list[str]) -> np.ndarray:
        """Rows of pieces; those that aren't remembered are learnt."""
        rows = np.fromiter(map(self.rows.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(rows < 0)
        if len(new):
            unseen = [pieces[i] for i in new.tolist()]
            found = list(self.learn(unseen))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            n, more = len(self.rows), int(sizes.sum())
            while self.used + more > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while n + len(new) > len(self.start):
                self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
            self.flat[self.used : self.used + more] = np.fromiter((i for x in found for i in x), np.uint32, more)
            self.start[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(new)] = sizes
            self.used += more
            rows[new] = np.arange(n, n + len(new))
            self.rows.update(zip(unseen, range(n, n + len(new)), strict=True))
        return rows

    def _some(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        found, before = self.pieces(texts)
        coded = found.dictionary_encode()
        if len(self.rows) + len(coded.dictionary) > self.bound:
            self.forget()
        row = self._row(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(found) else np.empty(0, np.int64)
        size = self.size[row]
        end = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[row] - end[:-1], size) + np.arange(end[-1])]
        return ids, end[before]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after another, and where those of each text begin and the last ends."""
        texts = texts.fill_null("")
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
        ids, at, first, held = [], [np.zeros(1, np.int64)], 0, 0
        for i, n in enumerate(lengths.tolist()):
            held += n
            if held >= AT_ONCE or i == len(lengths) - 1:
                some, edges = self._some(texts.slice(first, i + 1 - first))
                ids.append(some)
                at.append(edges[1:] + at[-1][-1])
                first, held = i + 1, 0
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.concatenate(at)
