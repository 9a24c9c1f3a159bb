import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from seqloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABET = ["a", "b", " ", "\n", "é", "ß", "中", "😀", "́", "1", "٣", "\x85", "\xa0", "\t", "'s", "<|endoftext|>", "the", "ing", "\x00", "Ⅷ"]


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBpe(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_same_ids_as_the_library(ours, theirs):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50)))
        assert ours.encode(text) == theirs.encode_ordinary(text)
        assert ours.decode(ours.encode(text), chunk=2) == text


def test_output_lags_by_a_bounded_lookahead(ours):
    machine, text = ours.machine, b"internationalization" * 40
    state, emitted, most = 0, 0, 0
    for n, b in enumerate(text, 1):
        known = machine._follow(state, b)
        state = known & 0xFFFFFFFF
        emitted += sum(len(machine.bytes_of[i]) for i in machine.runs[known >> 32])
        most = max(most, n - emitted)
    assert most <= 2 * max(map(len, machine.ranks))


def test_forgetting_states_changes_nothing(theirs):
    small = bpe.Transducer(bpe.read_ranks(PATH), states=50)
    for w in ["hello", "unbelievable", "antidisestablishmentarianism", "zzzzzzzz"]:
        assert small.encode(w.encode()) == theirs.encode_ordinary(w)


def test_utf8_machine_as_whole_decoding():
    rng = random.Random(5)
    raw = bytes(rng.choice(b"\xe2\x82\xac\xf0\x9f\x98\x80a\xc3\xa9\xed\xa0\xff\xf4\x90") for _ in range(4000))
    u = bpe.Utf8()
    assert "".join(u.feed(raw[i : i + 1]) for i in range(len(raw))) + u.finish() == raw.decode("utf-8", "replace")


def test_odd_rows(spark, theirs):
    long = "word " * 30_000 + "é" * 3000
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, long, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH, P.PATTERN).collect())
    want = []
    for d, t, _ in rows:
        ids = np.array(theirs.encode_ordinary(t or ""), "<u4")
        want.append((d or -1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).collect() == []
    ids = bpe.encode(df, PATH, P.PATTERN, with_text=True).collect()
    assert {r.decoded for r in ids} == {"a b", "", long}
