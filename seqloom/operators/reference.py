"""Reference sequences as tables: tiles, k-mers and their frequencies, letter counts, the catalogue."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dna
from ..ship import ship
from .mask import BITS, Mask, mask

#: Tiles keep substring() cheap, which walks from the start of its string; so many are made at a time.
WINDOW_TILE, AT_ONCE = 1024, 4096
#: Letters whose k-mers are coded at a time.
SEGMENT = 1 << 20
#: k-mers whose counts a task holds.
MOST_HELD = 1 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; what is split already does not move."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def place(seq_id, tile):
    """The key of a tile in a mask; of numbers or columns."""
    modulo = F.pmod if isinstance(seq_id, Column) else lambda x, y: x % y
    return modulo(seq_id, F.lit(BITS) if isinstance(seq_id, Column) else BITS) * 4099 + tile


def tiles(ref: DataFrame, size: int, before: int, after: int, among: Mask | None = None) -> DataFrame:
    """seq_id, tile, begin (0-based, of text), text: pieces of the sequences with their neighbourhood.

    One pass over each sequence, in Arrow batches of a few megabytes: the time is that of the letters. among: of the
    places that are asked for; other tiles need not come.
    """
    ship(ref.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        for b in batches:
            ids = np.array(b.column("seq_id").to_pylist(), np.int64)
            count = -(-pc.fill_null(pc.utf8_length(b.column("seq")), 0).to_numpy(zero_copy_only=False).astype(np.int64) // size)
            rows = np.repeat(np.arange(len(ids)), count)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            if among is not None:
                asked = among.has(place(ids[rows], part))
                rows, part = rows[asked], part[asked]
            now, seq = -1, ""
            for i in range(0, len(rows), AT_ONCE):
                begins, texts = [], []
                for row, tile in zip(rows[i : i + AT_ONCE].tolist(), part[i : i + AT_ONCE].tolist(), strict=True):
                    if row != now:
                        now, seq = row, b.column("seq")[row].as_py()  # one sequence at a time
                    begins.append(max(0, tile * size - before))
                    texts.append(seq[begins[-1] : tile * size + size + after])
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[i : i + AT_ONCE]]), pa.array(part[i : i + AT_ONCE].astype(np.int32)), pa.array(begins, pa.int32()), pa.array(texts, pa.string())], names=["seq_id", "tile", "begin", "text"])

    some = ref.select(F.col("seq_id").cast("bigint").alias("seq_id"), "seq")
    return some.mapInArrow(run, "seq_id bigint, tile int, begin int, text string")


def is_prepared(ref) -> bool:
    return not isinstance(ref, DataFrame)


def windows(ref, pad: int, asked: DataFrame) -> DataFrame:
    """seq_id, tile, begin, text: tiles of WINDOW_TILE letters with at least pad around; those asked for (seq_id, tile), and maybe others."""
    if is_prepared(ref) and ref.pad >= pad:
        return ref.windows
    ref = ref.sequences if is_prepared(ref) else ref
    return tiles(ref, WINDOW_TILE, pad, pad, mask(asked, place(F.col("seq_id").cast("bigint"), F.col("tile"))))


def pieces(batches, overlap: int):
    """Sequences of Arrow batches in pieces of about SEGMENT letters: ids, begins in the letters, where each begins in its sequence, letters (bytes), starts that count.

    Short sequences stand together in one piece, a line feed between them; of a long one each piece has the first
    letters (overlap) of the next.
    """
    import numpy as np

    held, ids, size = [], [], 0

    def together():
        n = np.array([len(s) for s in held], np.int64)
        x = np.frombuffer("\n".join(held).encode("latin-1", "replace"), np.uint8)
        return np.array(ids, np.int64), np.cumsum(n + 1) - n - 1, np.zeros(len(n), np.int64), x, len(x)

    for b in batches:
        has = "seq_id" in b.schema.names
        for seq_id, seq in zip(b.column("seq_id").to_pylist() if has else [0] * b.num_rows, b.column("seq"), strict=True):
            seq = seq.as_py()  # one sequence at a time
            if not seq:  # told here: a filter before would make the letters once more
                continue
            if len(seq) > SEGMENT:
                for at in range(0, len(seq), SEGMENT):
                    x = np.frombuffer(seq[at : at + SEGMENT + overlap].encode("latin-1", "replace"), np.uint8)
                    yield np.array([seq_id], np.int64), np.zeros(1, np.int64), np.array([at], np.int64), x, min(SEGMENT, len(seq) - at)
                continue
            held.append(seq)
            ids.append(seq_id)
            size += len(seq) + 1
            if size > SEGMENT:
                yield together()
                held, ids, size = [], [], 0
    if held:
        yield together()


def codes(x, starts: int, begins, sizes: list[int]):
    """Of the letters of a piece: q, codes of the q-mers from each of its first places, and which of them hold bases alone. No letters are found at each place of a sequence."""
    import numpy as np

    value = np.full(256, 4, np.uint8)
    value[[ord(c) for c in "ACGT"]] = range(4)
    v = value[x]
    odd = np.concatenate([np.zeros(1, np.int32), np.cumsum(v > 3, dtype=np.int32)])
    kind = np.uint32 if max(sizes) <= 16 else np.int64
    # codes of 1, 2, 4, 8... letters, of which those of each size are made
    powers = {1: (v & 3).astype(kind)}
    while 2 * max(powers) <= max(sizes):
        p = max(powers)
        c = powers[p]
        powers[2 * p] = c[: max(0, len(c) - p)] << kind(2 * p) | c[p:]
    for q in sizes:
        n = min(starts, len(x) - q + 1)
        if n <= 0:
            continue
        if q == 0:
            good = np.ones(n, bool)
            good[begins[1:] - 1] = False
            yield q, np.zeros(n, np.int64), good
            continue
        code, done = None, 0
        for p in sorted(powers, reverse=True):
            if done + p <= q:
                part = powers[p][done : done + n]
                code, done = part if code is None else code << kind(2 * p) | part, done + p
        yield q, code, odd[q : q + n] == odd[:n]


def kmers(ref, *sizes: int, among: Mask | None = None) -> DataFrame:
    """q, code (two bits a base), seq_id, pos (0-based) of every k-mer of each of the sizes, of bases alone; those that a prepared reference has are read.

    among: of the codes that are asked for; others need not come.
    """
    if is_prepared(ref):
        own = ref.kmers.select(F.lit(ref.k).alias("q"), "code", "seq_id", "pos")
        rest = [s for s in sizes if s != ref.k]
        made = kmers(ref.sequences, *rest, among=among) if rest else None
        return made if ref.k not in sizes else own if made is None else own.unionByName(made)
    ship(ref.sparkSession)

    def run(batches):
        import numpy as np

        for ids, begins, ats, x, starts in pieces(batches, max(sizes)):
            for q, code, good in codes(x, starts, begins, list(sizes)):
                if among is not None:
                    good = good & among.has(code)
                pos = np.flatnonzero(good)
                if not len(pos):
                    continue
                of = np.searchsorted(begins, pos, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), q, np.int32)), pa.array(code[pos].astype(np.int64)), pa.array(ids[of]), pa.array((pos - begins[of] + ats[of]).astype(np.int32))], names=["q", "code", "seq_id", "pos"])

    some = dealt(ref).select(F.col("seq_id").cast("bigint").alias("seq_id"), "seq")
    return some.mapInArrow(run, "q int, code bigint, seq_id bigint, pos int")


def kmer_frequencies(ref: DataFrame, k: int) -> DataFrame:
    """kmer, n: counted in each task piece by piece, then summed. A task holds a table of all k-mers, or MOST_HELD of those seen where there may be more."""
    ship(ref.sparkSession)

    def run(batches):
        import numpy as np

        def out(code, n):
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

        found = (code[good] for _, begins, _, x, starts in pieces(batches, k) for _, code, good in codes(x, starts, begins, [k]))
        if 4**k <= MOST_HELD:
            n = np.zeros(4**k, np.int64)
            for code in found:
                n += np.bincount(code, minlength=4**k)
            yield out(np.flatnonzero(n), n[n > 0])
            return
        seen, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for code in found:
            c, n = np.unique(code, return_counts=True)
            seen, where = np.unique(np.concatenate([seen, c]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n]), len(seen)).astype(np.int64)
            if len(seen) > MOST_HELD:
                yield out(seen, counts)
                seen, counts = seen[:0], counts[:0]
        yield out(seen, counts)

    rows = dealt(ref).select("seq").mapInArrow(run, "code bigint, n bigint")
    return rows.groupBy("code").agg(F.sum("n").alias("n")).select(dna.unpacked(F.col("code"), k).alias("kmer"), "n")


def letter_counts(ref: DataFrame) -> DataFrame:
    """letter, n over all sequences: counted inside each row, then summed."""
    per = [F.struct(F.lit(c).alias("letter"), (F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))).cast("bigint").alias("n")) for c in "ACGT"]
    return ref.select(F.inline(F.array(*per))).groupBy("letter").agg(F.sum("n").alias("n")).where("n > 0")


def catalogue(ref: DataFrame, block: int = 1 << 16) -> DataFrame:
    """seq_id, seq_name, len, start: the place of each sequence in their concatenation by seq_id.

    Lengths are summed within blocks of ids and then over the blocks, so that no task sums all of them.
    """
    by = ref.select("seq_id", "seq_name", F.length("seq").cast("bigint").alias("len"), F.floor(F.col("seq_id") / block).alias("block"))
    sums = by.groupBy("block").agg(F.sum("len").alias("all"))
    before = sums.select("block", (F.sum("all").over(W.orderBy("block")) - F.col("all")).alias("before"))
    inside = F.sum("len").over(W.partitionBy("block").orderBy("seq_id")) - F.col("len")
    return by.withColumn("inside", inside).join(before, "block").select("seq_id", "seq_name", "len", (F.col("before") + F.col("inside")).alias("start"))


def located(positions: DataFrame, catalogue: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Positions (pos, width) of the concatenation as seq_id and begin; found is "clipped" where a hit leaves its sequence.

    A range join made an equi-join: sequences are listed for each block that they touch.
    """
    spans = catalogue.where("len > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("len") - 1) / block))))
    at = positions.withColumn("block", F.floor(F.col("pos") / block))
    inside = at.join(spans, "block").where("pos >= start and pos < start + len")
    found = F.when(F.col("pos") + F.col("width") <= F.col("start") + F.col("len"), "found").otherwise("clipped")
    return inside.select(*positions.columns, "seq_id", (F.col("pos") - F.col("start")).alias("begin"), found.alias("found"))


def checked_names(ref: DataFrame) -> DataFrame:
    """The reference, or an error if two sequences share a name."""
    twice = ref.groupBy("seq_name").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two sequences are named {twice[0].seq_name!r}")
    return ref
