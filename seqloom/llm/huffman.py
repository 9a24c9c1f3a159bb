"""Operator 7: token ids in binary files, in a canonical length-limited Huffman code.

One code for the whole corpus: counts of every id are summed in Spark (as many rows as the vocabulary has
ids), and package-merge gives the best code whose words have at most LIMIT bits. Canonical codes need only
their lengths stored. Each range of doc_ids becomes one file: a header with the lengths, independent
blocks, an index of documents, a footer. A block holds its bits and the bit offset of every LANE-th id, so
any stretch can be decoded alone; the decoder reads one table entry per id and runs all stretches abreast.

Files are written by Spark's text sink, a frame for each row (the line feed after it is part of the
format), so any file system that Spark knows will do.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; repeated rows stay, in
the order of doc_id, length, ids; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .bpe import _on
from .common import cut, delete, drop, ready, rows_per_batch, shared_dir, together
from .pieces import Pieces

LIMIT, LANE, BLOCK, FILE_IDS = 20, 512, 1 << 16, 1 << 22
#: Tasks that write, at most; files of one task are numbered from its own number times SEGMENTS.
TASKS, SEGMENTS = 20_000, 10_000_000
MAGIC = b"SLHF0001"
HEAD = struct.Struct("<cI")


# --- the code


def limited_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the optimal prefix code with words of at most limit bits (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    row, levels = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        even = row[: len(row) // 2 * 2]
        merged = np.concatenate([leaves, even[::2] + even[1::2]])
        order = np.argsort(merged, kind="stable")
        row = merged[order]
        levels.append(order < len(leaves))
    need = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:need].sum())
        lengths[used[:k]] += 1
        need = 2 * (need - k)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: by length, then by id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - last
            codes[i], last = code, n
            code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Entry for each top bits: id << 5 | length."""
    top = int(lengths.max()) if len(lengths) else 0
    table = np.zeros(1 << top, np.uint32)
    codes = canonical(lengths)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    spans = np.int64(1) << (top - lengths[ids].astype(np.int64))
    if len(ids):
        filled = np.repeat(ids.astype(np.uint32) << np.uint32(5) | lengths[ids], spans)
        first = int(codes[ids[0]]) << (top - int(lengths[ids[0]]))
        table[first : first + len(filled)] = filled
    return table, top


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of ids in big-endian 32-bit words, and each id's bit offset."""
    both = (codes << np.uint64(8) | lengths)[ids]
    n = both & np.uint64(255)
    ends = np.cumsum(n)
    at = ends - n
    out = np.zeros(int(ends[-1] if len(ends) else 0) // 32 + 2, np.uint64)
    if len(ids):
        word = at >> np.uint64(5)
        v = (both >> np.uint64(8)) << (np.uint64(64) - (at & np.uint64(31)) - n)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        w = word[starts].astype(np.int64)
        out[w] += np.add.reduceat(v >> np.uint64(32), starts)
        out[w + 1] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), starts)
    return out.astype(">u4"), at


def unpack(words: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: np.ndarray, top: int) -> np.ndarray:
    """Ids of all stretches, each from its bit offset; all stretches advance together."""
    wide = words.astype(np.uint64)
    wide = wide[:-1] << np.uint64(32) | wide[1:]
    order = np.argsort(-counts, kind="stable")
    at, left = starts[order].astype(np.uint64), counts[order]
    out = np.zeros((int(counts.max()) if len(counts) else 0, len(order)), np.int32)  # a row for each step
    mask, shift = np.uint64((1 << top) - 1), np.uint64(64 - top)
    live = len(order)
    for k in range(len(out)):
        live = int(np.searchsorted(-left, -k, "left"))  # stretches with more than k ids come first
        here = at[:live]
        e = table[(wide[(here >> np.uint64(5)).astype(np.int64)] >> (shift - (here & np.uint64(31)))) & mask]
        out[k, :live] = e >> np.uint32(5)
        at[:live] += e & np.uint32(31)
    back = np.empty((len(order), len(out)), np.int32)
    for i in range(0, len(order), 256):
        back[order[i : i + 256]] = out[:, i : i + 256].T
    return back[np.arange(back.shape[1])[None, :] < counts[:, None]]


# --- the file


def frame(kind: bytes, body: bytes) -> bytes:
    return HEAD.pack(kind, len(body)) + body


def header(lengths: np.ndarray) -> bytes:
    return frame(b"H", MAGIC + struct.pack("<I", len(lengths)) + zlib.compress(lengths.tobytes(), 9))


def block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    words, at = pack(ids, codes, lengths)
    marks = at[::LANE].astype("<u4")
    return frame(b"B", struct.pack("<II", len(ids), len(marks)) + marks.tobytes() + words.tobytes())


def index(doc_ids: list[int | None], sizes: list[int]) -> bytes:
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    body = struct.pack("<I", len(ids)) + zlib.compress(null.tobytes() + ids.tobytes() + np.array(sizes, "<u4").tobytes(), 6)
    return frame(b"I", body + struct.pack(">Q", sum(sizes)))


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, their sizes, and all ids of one file."""
    at, words, marks, counts, base = 0, [], [], [], 0
    lengths, docs, sizes = np.zeros(0, np.uint8), [], np.zeros(0, np.int64)
    while at < len(content):
        kind, n = HEAD.unpack_from(content, at)
        body = memoryview(content)[at + HEAD.size : at + HEAD.size + n]
        at += HEAD.size + n + 1
        if kind == b"H":
            if bytes(body[:8]) != MAGIC:
                raise ValueError("not a file of this format")
            lengths = np.frombuffer(zlib.decompress(body[12:]), np.uint8)
        elif kind == b"B":
            ids, m = struct.unpack_from("<II", body)
            marks.append(np.frombuffer(body, "<u4", m, 8).astype(np.int64) + base * 32)
            counts.append(np.minimum(LANE, ids - LANE * np.arange(m)))
            words.append(np.frombuffer(body, ">u4", offset=8 + 4 * m))
            base += len(words[-1])
        elif kind == b"I":
            (m,) = struct.unpack_from("<I", body)
            raw = zlib.decompress(body[4:-8])
            null, ids = np.frombuffer(raw, np.uint8, m), np.frombuffer(raw, "<i8", m, m)
            docs = [None if z else int(d) for z, d in zip(null, ids, strict=True)]
            sizes = np.frombuffer(raw, "<u4", m, 9 * m).astype(np.int64)
    if not words:
        return docs, sizes, np.zeros(0, np.int32)
    table, top = decoding_table(lengths)
    return docs, sizes, unpack(np.concatenate(words), np.concatenate(marks), np.concatenate(counts), table, top)


# --- encoding with the tokenizers library


class Encoder:
    """The library's ids of whole texts.

    The library splits a text before it merges, so a text's ids are those of its pieces in turn: the library's
    own model encodes each piece once, and what it gave is remembered. How code points split is learnt from
    the library too. Texts with the string of an added token, and all texts if the file asks for more than this
    (a normaliser, another way to split), go to the library whole. Some text of each batch goes there
    as well, and an error is raised if the ids differ.
    """

    def __init__(self, path: str, bound: int = 600_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        first = how.get("pre_tokenizer") or {}
        self.usual = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not how.get("normalizer") and not how.get("truncation")
        if not self.usual:
            return
        cut = self.library.pre_tokenizer.pre_tokenize_str
        written = {}  # how the model writes each byte
        for c in map(chr, (*range(0x80), *range(0x80, 0x800, 0x40), *range(0x80, 0xC0), *range(0x800, 0x10000, 0x800), *range(0x10000, 0x110000, 0x8000))):
            if not 0xD800 <= ord(c) < 0xE000:
                written.update(zip(c.encode(), "".join(x for x, _ in cut(c)), strict=True))
        written, tokenize = {chr(b): c for b, c in written.items()}, self.library.model.tokenize
        table = str.maketrans(written)

        def learn(pieces: list[str]) -> list[list[int]]:
            return [[t.id for t in tokenize(p.encode().decode("latin-1").translate(table))] for p in pieces]

        self.pieces = Pieces(lambda text: [x for x, _ in cut(text)], learn, bound=bound)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), one after another, and where those of each begin and the last ends."""
        texts = texts.fill_null("")
        alone = np.full(len(texts), not self.usual)
        for a in self.added:
            alone |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if not alone.any():
            ids, at = self.pieces.encode(texts)
            self.check(texts, ids, at)
            return ids, at
        some = iter(()) if alone.all() else iter(np.split(*self.parts(texts.filter(pa.array(~alone)))))
        each = [self.whole(t.as_py()) if a else next(some) for t, a in zip(texts, alone, strict=True)]
        return np.concatenate(each), np.cumsum([0, *map(len, each)])

    def parts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        ids, at = self.pieces.encode(texts)
        return ids, at[1:-1]

    def check(self, texts: pa.StringArray, ids: np.ndarray, at: np.ndarray) -> None:
        """The shortest text that has ten ids or more, against the library."""
        n = np.diff(at)
        if (n >= 10).any():
            i = int(np.where(n >= 10, n, n.max() + 1).argmin())
            if not np.array_equal(self.whole(texts[i].as_py()), ids[at[i] : at[i + 1]]):
                raise ValueError("the pieces' ids are not the library's ids of the whole text")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(_on(path))
    return _ENCODERS[path]


def tokenized(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """doc_id, n, ids (little-endian, 16 bits each where the vocabulary allows, else 32) with the end id."""
    ready(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        wide = np.dtype("<u2" if enc.library.get_vocab_size() <= 1 << 16 else "<u4")
        for b in together(batches):
            ids, at = enc.encode(b.column("text"))
            ids = np.insert(ids.astype(wide), at[1:], end_id)
            at = at + np.arange(len(at))
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(b), [None, pa.py_buffer((at * wide.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), raw], names=["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def id_counts(tokens: DataFrame, vocab: int) -> np.ndarray:
    """Occurrences of each id over the whole corpus: one histogram a task, summed by Spark."""
    wide = "<u2" if vocab <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for b in batches:
            raw = b"".join(b.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(raw, wide), minlength=vocab)[:vocab]
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def write(tokens: DataFrame, lengths: np.ndarray, folder: str, total: int) -> None:
    """Files in ascending doc_id order, about FILE_IDS ids each: folder/segment=<number in order>.

    A task writes as many files as its range of doc_ids needs, so that neither files nor tasks grow too many.
    """
    codes, wide = canonical(lengths), np.dtype("<u2" if len(lengths) <= 1 << 16 else "<u4")

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * SEGMENTS
        docs, sizes, waiting, n, done = [], [], [], 0, 0

        def out(*frames: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number] * len(frames), pa.int64()), pa.array(frames, pa.binary())], names=["segment", "frame"])

        def end() -> pa.RecordBatch:
            last = [block(np.concatenate(waiting), codes, lengths)] if n else []
            return out(*last, index(docs, sizes))

        for b in batches:
            for doc, size, raw in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if not docs:
                    yield out(header(lengths))
                docs.append(doc)
                sizes.append(size)
                waiting.append(np.frombuffer(raw, wide))
                n += size
                if n >= BLOCK:
                    ids = np.concatenate(waiting)
                    whole = n // BLOCK * BLOCK
                    for i in range(0, whole, BLOCK):
                        yield out(block(ids[i : i + BLOCK], codes, lengths))
                    waiting, n, done = [ids[whole:]], n - whole, done + whole
                if done + n >= FILE_IDS:
                    yield end()
                    number, docs, sizes, waiting, n, done = number + 1, [], [], [], 0, 0
        if docs:
            yield end()

    order = [F.col("doc_id").asc_nulls_first(), F.col("n").asc()]
    # the first ids and the row's place let even rows of one doc_id be dealt out
    placed = tokens.withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(max(1, min(TASKS, -(-total // FILE_IDS))), *order, F.substring("ids", 1, 16), "place").sortWithinPartitions(*order, "ids")
    frames = ranged.mapInArrow(run, "segment bigint, frame binary")
    frames.select("segment", F.col("frame").cast("string").alias("value")).write.partitionBy("segment").text(folder)


def read(spark, folder: str) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.read.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").load(folder).where("length > 0")

    def run(batches):
        for b in batches:
            for number, content in zip(b.column("segment").to_pylist(), b.column("content").to_pylist(), strict=True):
                docs, sizes, ids = read_file(content)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                for i in range(0, len(docs), 10_000):
                    j = slice(i, i + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(docs[j])), pa.array(docs[j], pa.int64()), pa.array((ends - sizes)[j]), pa.array(sizes[j]), pa.array(crcs[j], pa.int64())], names=["segment", "doc_id", "at", "n_tokens", "ids_crc32"])

    with rows_per_batch(spark, 1):
        rows = cut(files.select(F.regexp_extract("path", "segment=([0-9]+)", 1).cast("bigint").alias("segment"), "content").mapInArrow(run, "segment bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"))
    # ids before each file: within its task's files, and those of earlier tasks
    sums = rows.groupBy("segment", F.floor(F.col("segment") / SEGMENTS).alias("task")).agg(F.sum("n_tokens").alias("n"))
    tasks = sums.groupBy("task").agg(F.sum("n").alias("all")).select("task", (F.sum("all").over(W.orderBy("task")) - F.col("all")).alias("before"))
    base = cut(sums.withColumn("inside", F.sum("n").over(W.partitionBy("task").orderBy("segment")) - F.col("n")).join(tasks, "task").select("segment", (F.col("before") + F.col("inside")).alias("base")))
    return rows.join(base, "segment").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Encode all documents, write the files, read them back; a folder that isn't given is deleted again."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocab = Tokenizer.from_file(path).get_vocab_size()
    tokens = cut(tokenized(docs, path))
    counts = id_counts(tokens, vocab)
    own = folder or shared_dir(spark)
    write(tokens, limited_lengths(counts), own, int(counts.sum()))
    drop(spark, tokens)
    found = read(spark, own)
    if folder is None:
        delete(spark, own)
    return found
