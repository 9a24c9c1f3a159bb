import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from tokenizers import Tokenizer

from seqloom.llm import huffman

PATH = P.path("byte_bpe_50k.json")


def huffman_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n in (2, 3, 7, 200, 3000):
        counts = (rng.pareto(0.7, n) * 10).astype(np.int64)
        counts[0] = 5
        lengths = huffman.limited_lengths(counts, 40)
        assert int((lengths * counts).sum()) == huffman_cost(counts) or np.count_nonzero(counts) < 2
        tight = huffman.limited_lengths(counts, 12)
        assert tight.max() <= 12 and sum(2.0 ** -int(x) for x in tight if x) <= 1


def test_blocks_decode_from_every_checkpoint():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 200_000) - 1, 5000).astype(np.int64)
    lengths = huffman.limited_lengths(np.bincount(ids, minlength=5001))
    codes = huffman.canonical(lengths)
    content = b"".join(f + b"\n" for f in (huffman.header(lengths), *(huffman.block(ids[i : i + 65536], codes, lengths) for i in range(0, len(ids), 65536)), huffman.index([None, 4], [1000, len(ids) - 1000])))
    docs, sizes, back = huffman.read_file(content)
    assert docs == [None, 4] and sizes.tolist() == [1000, len(ids) - 1000] and (back == ids).all()


def test_encoder_gives_the_librarys_ids():
    enc, lib, rng = huffman.Encoder(PATH), Tokenizer.from_file(PATH), random.Random(4)
    parts = ["a", " ", "  ", "\n", "é", "中", "😀", "'s", "<|endoftext|>", "the", "ing", "\x1c", "\x85", "᠎", "1", "Ⅷ", "\t", "\xa0", "…", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for some in (texts, [t.replace("<|endoftext|>", "'re'") for t in texts], [" ", "", "a  b", "a\n 'll's 'vex"]):
        ids, at = enc.encode(pa.array(some))
        for i, t in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_every_code_point_splits_as_in_the_library():
    """Each of the first three planes beside a letter, a number, a blank and itself."""
    enc, lib = huffman.Encoder(PATH), Tokenizer.from_file(PATH)
    points = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800, 7), *range(0xF900, 0x11000), *range(0x1D000, 0x20000, 5), 0x2FFFF, 0x10FFFF]]
    points = [c for c in points if not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}{c}!{c}  {c}" for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    ids, at = enc.encode(pa.array(texts))
    for i, e in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids


def test_a_wrong_table_is_noticed():
    enc = huffman.Encoder(PATH)
    enc.pieces.kinds[ord("x")] = 2
    with pytest.raises(ValueError, match="library"):
        enc.encode(pa.array(["axaxax bxb cxc xx axaxax"]))


def test_round_trip_with_odd_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(huffman, "FILE_IDS", 3000)
    lib = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    rows = [(i * 7 % 50, " ".join(rng.choice(["alpha", "be ta", "g", "émile"]) for _ in range(rng.randint(0, 300))), 1) for i in range(50)]
    rows += [(None, None, 2), (51, "", 3), (7, "again", 4), (52, "x y " * 20_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in huffman.round_trip(df, PATH).collect()), key=lambda x: x[1])
    enc = [(d if d is not None else -1, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows]
    enc.sort(key=lambda x: (x[0], len(x[1]), np.array(x[1], "<u2").tobytes()))
    at, want = 0, []
    for d, ids in enc:
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    # several files a task, in the order of their numbers; the same rows from files that stay
    monkeypatch.setattr(huffman, "TASKS", 2)
    monkeypatch.setattr(huffman, "FILE_IDS", 700)
    again = huffman.round_trip(df, PATH, f"file://{tmp_path}/files")
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in again.collect()), key=lambda x: x[1]) == want
    assert len(list((tmp_path / "files").glob("segment=*"))) > 12
    # repeated rows come out as often as they went in
    twice = huffman.round_trip(df.where("doc_id = 7").unionByName(df.where("doc_id = 7")), PATH).collect()
    assert len(twice) == 4 and len({r.start for r in twice}) == 4
    assert huffman.round_trip(df.limit(0), PATH).collect() == []
