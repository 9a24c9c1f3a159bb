"""Alignment kernels over many candidates at once (numpy)."""

from __future__ import annotations

import numpy as np

#: Candidates whose matrices are held at a time.
AT_ONCE = 128


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("latin-1", "replace"), np.uint8)


def mismatches(read: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of equal length; N in a read matches nothing."""
    return ((read != windows) | (read == ord("N"))).sum(1)


def matrices(reads: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Edit distances D[c, i, j] between the first j letters of read c and the best end at i of its window; the start is free."""
    b, m = reads.shape
    ramp = np.arange(m + 1, dtype=np.int16)
    d = np.empty((b, windows.shape[1] + 1, m + 1), np.int16)
    d[:, 0] = ramp
    odd = reads == ord("N")
    for i in range(windows.shape[1]):
        differ = (reads != windows[:, i : i + 1]) | odd
        row = d[:, i] + 1
        row[:, 0] = 0
        np.minimum(row[:, 1:], d[:, i, :-1] + differ, out=row[:, 1:])
        d[:, i + 1] = np.minimum.accumulate(row - ramp, axis=1) + ramp
    return d


def ends(last: np.ndarray, most: int) -> np.ndarray:
    """Local minima, at most `most`, of a final column: the centres of clusters of ends."""
    above = np.concatenate([[last[0]], last[:-1]])
    below = np.concatenate([last[1:], [last[-1]]])
    return np.flatnonzero((last <= most) & (last <= above) & (last <= below))


def trace(d: np.ndarray, read: np.ndarray, window: np.ndarray, end: int) -> tuple[int, str]:
    """Begin in the window and CIGAR of the alignment that ends at `end`: insertions first, then the diagonal, then deletions."""
    i, j, runs = end, len(read), []
    while j:
        if d[i, j] == d[i, j - 1] + 1:
            op, j = "I", j - 1
        elif i and d[i, j] == d[i - 1, j - 1] + (read[j - 1] != window[i - 1] or read[j - 1] == ord("N")):
            op, i, j = "M", i - 1, j - 1
        else:
            op, i = "D", i - 1
        if runs and runs[-1][1] == op:
            runs[-1][0] += 1
        else:
            runs.append([1, op])
    return i, "".join(f"{n}{op}" for n, op in reversed(runs))


def align(reads: list[str], windows: list[str], most: list[int]) -> list[list[tuple[int, int, int, str]]]:
    """begin, end, distance, CIGAR (window coordinates) of each candidate's ends."""
    out: list[list[tuple[int, int, int, str]]] = [[] for _ in reads]
    shapes: dict[tuple[int, int], list[int]] = {}
    for c, (r, w) in enumerate(zip(reads, windows, strict=True)):
        if r and w:
            shapes.setdefault((len(r), len(w)), []).append(c)
    for rows in shapes.values():
        for k in range(0, len(rows), AT_ONCE):
            some = rows[k : k + AT_ONCE]
            r, w = np.stack([codes(reads[c]) for c in some]), np.stack([codes(windows[c]) for c in some])
            d = matrices(r, w)
            for x, c in enumerate(some):
                for e in ends(d[x, :, -1], most[c]):
                    begin, cigar = trace(d[x], r[x], w[x], int(e))
                    out[c].append((begin, int(e), int(d[x, e, -1]), cigar))
    return out
