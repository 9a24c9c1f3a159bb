"""Operator 4: byte-level BPE encoding and decoding.

Encoding compiles the merges into a transducer over bytes. Two facts make it finite: each prefix of a
piece has exactly one encoding, and a token sequence is an encoding if and only if each adjacent pair
is one. The undetermined machine guesses which token covers the next bytes; a state of the determinised
machine holds all live guesses (tokens not yet emitted, and the place in the token trie), and what they
agree on is emitted at once. So output lags input by no more than the guesses can differ. States and
transitions are made when first needed and forgotten when there are too many.

Decoding streams: token bytes go through a UTF-8 state machine that carries an unfinished character
from one chunk to the next.

Defined results: null and empty texts give no ids and the digest of nothing; repeated rows stay
repeated rows; a null doc_id stays null; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ready, together
from .pieces import RUNS, Pieces

NONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: A guess is an integer: the number of its pending tokens, then its trie node in so many bits.
NODE_BITS = 21
NODE_MASK = (1 << NODE_BITS) - 1


class Transducer:
    """The lazily determinised machine of one vocabulary.

    A state is the last token emitted and the live guesses, packed into bytes; sequences of tokens are kept once.
    """

    def __init__(self, ranks: dict[bytes, int], states: int = 300_000):
        self.ranks, self.bound = ranks, states
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.trie: dict[int, int] = {}
        self.token_at = [NONE]
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            node = 0
            for b in token:
                below = self.trie.get(node << 8 | b)
                if below is None:
                    below = self.trie[node << 8 | b] = len(self.token_at)
                    self.token_at.append(NONE)
                node = below
            self.token_at[node] = rank
        if len(self.token_at) > NODE_MASK:
            raise ValueError("too large a vocabulary")
        self.inner = bytearray(len(self.token_at))
        for k in self.trie:
            self.inner[k >> 8] = 1
        self.pairs: dict[int, bool] = {}
        self.last_merge: dict[int, tuple[int, int] | None] = {}
        self.whole: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = array("q", [NONE, 0]).tobytes()
        self.ids, self.sets = {start: 0}, [start]
        self.runs, self.run_ids = [()], {(): 0}
        #: (state, byte) -> the run of tokens emitted, then the next state in 32 bits
        self.step: dict[int, int] = {}

    def _run(self, tokens: tuple[int, ...]) -> int:
        n = self.run_ids.get(tokens)
        if n is None:
            n = self.run_ids[tokens] = len(self.runs)
            self.runs.append(tokens)
        return n

    def merge(self, piece: bytes) -> list[int]:
        """Encoding by the definition: merge the adjacent pair of lowest rank, again and again."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last; None for single bytes."""
        if token not in self.last_merge:
            whole, n = self.bytes_of[token], len(self.bytes_of[token])
            self.last_merge[token] = None
            if n > 1:
                parts = [whole[i : i + 1] for i in range(n)]
                while len(parts) > 2:
                    best, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.bytes_of)), i) for i in range(len(parts) - 1))
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                self.last_merge[token] = self.ranks[parts[0]], self.ranks[parts[1]]
        return self.last_merge[token]

    def _adjacent(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as a, b.

        Their merges are undone from the last to the first; a merge across the border that would have
        come before the one undone makes another encoding.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known, before, text, rank = True, len(self.bytes_of) + 1, self.bytes_of, self.ranks.get
            while True:
                across = rank(text[a] + text[b])
                if across is not None and across < before:
                    known = False
                    break
                left, right = self._halves(a), self._halves(b)
                if left is None and right is None:
                    break
                # ties go to the merge further left, so one inside a is made before an equal one across
                if right is None or (left is not None and a > b):
                    before, a = a, left[1]
                else:
                    before, b = b + 1, right[0]
            self.pairs[key] = known
        return known

    def _single(self, a: int) -> bool:
        known = self.whole.get(a)
        if known is None:
            known = self.whole[a] = self.merge(self.bytes_of[a]) == [a]
        return known

    def _follow(self, state: int, byte: int) -> int:
        codes = array("q", self.sets[state])
        last, trie, runs, token_at = codes[0], self.trie, self.runs, self.token_at
        live, done = [], None
        for code in codes[1:]:
            below = trie.get((code & NODE_MASK) << 8 | byte)
            if below is None:
                continue
            if done is None:
                token = token_at[below]
                if token >= 0:
                    pending = runs[code >> NODE_BITS]
                    before = pending[-1] if pending else last
                    if self._single(token) if before < 0 else self._adjacent(before, token):
                        done = (*pending, token)
            if self.inner[below]:
                live.append(code & ~NODE_MASK | below)
        if done is None:
            raise ValueError(f"no token holds byte {byte}")
        live.append(self._run(done) << NODE_BITS)
        out = 0
        if live[0] >> NODE_BITS:  # what all guesses agree on is out
            pending = [runs[c >> NODE_BITS] for c in live]
            first = pending[0]
            same = len(first)
            for p in pending:
                k = 0
                while k < same and k < len(p) and p[k] == first[k]:
                    k += 1
                same = k
                if not same:
                    break
            if same:
                out, last = self._run(first[:same]), first[same - 1]
                live = [self._run(p[same:]) << NODE_BITS | c & NODE_MASK for p, c in zip(pending, live, strict=True)]
        key = array("q", [last, *live]).tobytes()
        new = self.ids.get(key)
        if new is None:
            new = self.ids[key] = len(self.sets)
            self.sets.append(key)
        out = self.step[state << 8 | byte] = out << 32 | new
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.step) > self.bound:
            self._forget()
        state, out, step, runs = 0, [], self.step, self.runs
        for b in piece:
            known = step.get(state << 8 | b)
            if known is None:
                known = self._follow(state, b)
            state = known & 0xFFFFFFFF
            if known >> 32:
                out.extend(runs[known >> 32])
        out.extend(runs[array("q", self.sets[state])[-1] >> NODE_BITS])  # the guess that ends here stands last
        return out


class Utf8:
    """Incremental UTF-8: feed() returns the text of all finished characters and keeps the rest as its state.

    The state is how many continuation bytes are open, with the bytes themselves; ill-formed bytes
    become U+FFFD as in Python's "replace".
    """

    def __init__(self) -> None:
        self.open = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that may still become a character."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF5 else 1
                if back >= need:
                    return 0
                if back >= 2:  # ranges of the second byte
                    second = data[-back + 1]
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                    if not low <= second <= high:
                        return 0
                return back if b >= 0xC2 else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        keep = self._unfinished(data)
        self.open = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class ByteBpe:
    """Encoder and decoder of one rank file; room is the number of transitions that are remembered (about 600 bytes each with all else). Of pieces as many as a batch of texts may well hold are remembered, or a third of room."""

    def __init__(self, path: str, pattern: str, room: int = 300_000):
        import regex

        self.machine = machine = Transducer(read_ranks(path), room)
        self.pieces = Pieces(regex.compile(pattern).findall, lambda some: [machine.encode(p.encode()) for p in some], pattern == RUNS, max(1000, min(room, 300_000), room // 3))
        sizes = np.fromiter(map(len, machine.bytes_of), np.int64, len(machine.bytes_of))
        self.token_bytes = np.frombuffer(b"".join(machine.bytes_of), np.uint8)
        self.token_size, self.token_start = sizes, np.cumsum(sizes) - sizes

    def forget(self) -> None:
        """Give back what was remembered."""
        self.machine._forget()
        self.machine.pairs.clear()
        self.pieces.forget()

    def encode_all(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where those of each begin and the last ends."""
        return self.pieces.encode(texts)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        size = self.token_size[ids]
        return self.token_bytes[np.repeat(self.token_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()

    def decode_stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        machine = Utf8()
        for chunk in chunks:
            yield machine.feed(self.decode_bytes(chunk))
        yield machine.finish()

    def decode(self, ids: np.ndarray | list[int], chunk: int = 4096) -> str:
        ids = np.asarray(ids, np.int64)
        return "".join(self.decode_stream(ids[i : i + chunk] for i in range(0, len(ids), chunk)))


_CODERS: dict[tuple[str, str, int], ByteBpe] = {}


def coder(path: str, pattern: str, room: int = 300_000) -> ByteBpe:
    """One coder per worker process."""
    if (path, pattern, room) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, pattern, room] = ByteBpe(path, pattern, room)
    return _CODERS[path, pattern, room]


def _on(path: str):
    """Where an executor finds a file of the installed vocabularies, if it isn't at the given path."""
    import os

    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Columns of keep, with ids array<int>, n_tokens, and (with_text) the text decoded from the ids again."""
    ready(docs.sparkSession)
    kept = docs.select(*keep, "text")
    fields = [f for f in kept.schema.fields if f.name in keep]

    def run(batches):
        c = coder(_on(path), pattern)
        for b in together(batches):
            ids, at = c.encode_all(b.column("text"))
            cols = [b.column(f.name) for f in fields]
            cols += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32))), pa.array(np.diff(at), pa.int64())]
            if with_text:
                cols.append(pa.array([c.decode(ids[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields] + ["ids", "n_tokens"] + ["decoded"] * with_text)
        c.forget()  # other stages run in the same workers

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>, n_tokens bigint" + ", decoded string" * with_text
    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, room: int = 1_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded from the ids in a stream."""
    ready(docs.sparkSession)

    def run(batches):
        c = coder(_on(path), pattern, room)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in together(batches):
            ids, at = c.encode_all(b.column("text"))
            first, second = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                first.append(sha(ids[i:j].astype("<u4", copy=False).tobytes()))
                back = hashlib.sha256()
                for piece in c.decode_stream(ids[k : min(k + 4096, j)] for k in range(i, j, 4096)):
                    back.update(piece.encode())
                second.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
