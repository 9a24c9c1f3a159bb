"""k-mers on their way to the buckets of a table: what a task has of one bucket travels as one row of packed numbers, and Spark's rows are made where they are written."""

from __future__ import annotations

import struct
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from . import reference

#: Letters whose k-mers are packed together; k-mers put in order at a time; rows of a batch.
LETTERS, RUN, ROWS = 1 << 22, 10_000_000, 1 << 17


def bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    """Spark's bucket of codes (bigint, below 2^32)."""
    turn = lambda x, r: x << np.uint32(r) | x >> np.uint32(32 - r)
    h = np.full(len(code), 42, np.uint32)
    for word in (code.astype(np.uint32), np.zeros(1, np.uint32)):
        h = turn(h ^ turn(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % buckets


def first_of_buckets(buckets: int) -> np.ndarray:
    """The least code of each bucket: what stands for the bucket when rows are dealt out."""
    first, n = np.full(buckets, -1, np.int64), 4 * buckets
    while (first < 0).any():
        n *= 2
        code = np.arange(n - 1, -1, -1, dtype=np.int64)
        first[bucket(code, buckets)] = code
    return first


def pack(*columns: np.ndarray) -> bytes:
    """Numbers byte by byte, first the lowest of all; no more bytes than the largest needs."""
    head, out = [], []
    for a in columns:
        a = a.astype("<i8")
        n = 8 if len(a) and a.min() < 0 else -(-int(a.max()).bit_length() // 8) if len(a) else 0
        head.append(struct.pack("<BI", n, len(a)))
        out.append(a.view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes())
    body = b"".join(head + out)
    return struct.pack("<IB", len(body), len(columns)) + pa.compress(body, "zstd", asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    size, columns = struct.unpack_from("<IB", body)
    body = pa.decompress(body[5:], size, "zstd", asbytes=True)
    at, out = 5 * columns, []
    for c in range(columns):
        n, rows = struct.unpack_from("<BI", body, 5 * c)
        a = np.zeros((rows, 8), np.uint8)
        a[:, :n] = np.frombuffer(body, np.uint8, n * rows, at).reshape(n, rows).T
        out.append(a.view("<i8").ravel())
        at += n * rows
    return out


def steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def in_order(where: np.ndarray, code: np.ndarray, place: np.ndarray, buckets: int, k: int):
    """Bucket, code and place, by these: one bucket after the other."""
    low = int(place.max(initial=0)).bit_length()
    if low + 2 * k + buckets.bit_length() > 63:
        order = np.lexsort((place, code, where))
        edges = np.searchsorted(where, np.arange(buckets + 1), sorter=order)
        for n, (i, j) in enumerate(pairwise(edges.tolist())):
            yield n, code[order[i:j]].astype(np.int64), place[order[i:j]].astype(np.int64)
        return
    key = where.astype(np.int64)  # one number of all three, made and sorted in its place
    for bits, x in ((2 * k, code), (low, place)):
        key <<= bits
        key |= x
    key.sort()
    edges = np.searchsorted(key, np.arange(buckets + 1) << (2 * k + low))
    for n, (i, j) in enumerate(pairwise(edges.tolist())):
        yield n, key[i:j] >> low & (1 << 2 * k) - 1, key[i:j] & (1 << low) - 1


def by_bucket(ref: DataFrame, k: int, buckets: int) -> DataFrame:
    """code, seq_id, pos of the k-mers (at most 15 letters), in as many partitions as buckets, each with the k-mers that Spark puts in one bucket, mostly in order."""
    ship(ref.sparkSession)
    first = first_of_buckets(buckets)

    def rows_of(held):
        ids, begins, ats, where, code, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        # where sequences begin costs some two bytes for each in every bucket, to name them half a byte for each k-mer
        few = 4 * len(ids) * buckets < len(code)
        head, codes, bodies = pack(steps(ids), *([steps(begins), ats] if few else [])), [], []
        for n, code, place in in_order(where, code, place, buckets, k):  # noqa: B020, PLR1704
            if len(code):
                codes.append(first[n])
                of = None if few else np.searchsorted(begins, place, "right") - 1
                bodies.append(pack(steps(code), place) if few else pack(steps(code), of, place - begins[of] + ats[of]))
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array([head] * len(bodies), pa.binary()), pa.array(bodies, pa.binary())], names=["code", "head", "body"])

    def packed(batches):
        held, n = [], 0
        for ids, begins, ats, x, starts in reference.pieces(batches, k):
            for _, code, good in reference.codes(x, starts, begins, [k]):
                pos = np.flatnonzero(good)
                code = code[pos]
                held.append((ids, begins + n, ats, bucket(code, buckets).astype(np.uint32), code, (pos + n).astype(np.uint32)))
                n += len(x) + 1
            if n >= LETTERS:
                yield rows_of(held)
                held, n = [], 0
        if held:
            yield rows_of(held)

    def rows(held):
        code, seq_id, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        # by code, sequence and place (as they came): differences are small then; codes in two rounds of sixteen bits
        order = np.argsort(seq_id, kind="stable").astype(np.uint32)
        for shift in (0, 16):
            order = order[np.argsort((code[order] >> np.uint32(shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        for i in range(0, len(order), ROWS):
            o = order[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(code[o].astype(np.int64)), pa.array(seq_id[o]), pa.array(pos[o])], names=["code", "seq_id", "pos"])

    def unpacked(batches):
        held, n = [], 0
        for b in batches:
            for head, body in zip(b.column("head"), b.column("body"), strict=True):
                (ids, *rest), (code, *at) = unpack(head.as_py()), unpack(body.as_py())
                if rest:
                    begins, (place,) = np.cumsum(rest[0]), at
                    of = np.searchsorted(begins, place, "right") - 1
                    at = of, place - begins[of] + rest[1][of]
                held.append((np.cumsum(code).astype(np.uint32), np.cumsum(ids)[at[0]], at[1].astype(np.int32)))
                n += len(code)
                if n >= RUN:
                    yield from rows(held)
                    held, n = [], 0
        if held:
            yield from rows(held)

    some = reference.dealt(ref).select(F.col("seq_id").cast("bigint").alias("seq_id"), "seq")
    moved = some.mapInArrow(packed, "code bigint, head binary, body binary").repartition(buckets, "code")
    return moved.mapInArrow(unpacked, "code bigint, seq_id bigint, pos int")
