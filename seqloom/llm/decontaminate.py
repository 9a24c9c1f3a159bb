"""Operator 5: benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of every document. Items are dealt into classes by length, a class for each
power of two, and an item meets windows of two strides of its class, in one of which its stretch lies whole; the
sketch is taken over windows of the median item's class.
Their TF-IDF matrix has a column for each benchmark term (terms of many items, which tell nothing apart, are
left out, but each item keeps LEAST of its terms and as many as cover more words than a leak may lack). One pass
over all documents gathers document frequencies and the sketch C'(C X) of the count matrix C with a random X,
summed by Spark; scaled by the IDF and joined with the benchmark's own rows it gives the leading right singular
vectors (a one-pass randomised SVD of a positive matrix). The corpus' leading directions expand each item's row: terms
that stand where the item's terms stand in the corpus get a weight in it (EXPANDED of them at most, each of TRIM
of the item's largest). A second pass searches all passages: candidates are

- all pairs of a passage and an item of its class whose cosine, of the passage's row and the item's expanded row, is at
  least NEAR, and
- all pairs that share so much of the item's columns and answer that a leak is possible at all, whatever their
  cosine: this loses none, however the latent space was cut.

Candidates are checked on their words, within a stretch little longer than the item: a leak has a longest common
subsequence of DIRECT of the item, or of LOOSE of it if ANSWERED of the item's answer (its last ANSWER words that
are columns) is there too, or, for candidates by cosine (paraphrases), of FAINT with SAID of the answer. Each leak is
reported with its cosine, of columns that occur or not (repeated words don't dilute it): the larger of that in the
latent space and that of the TF-IDF rows, as the latent space has at most RANK dimensions.

Words are runs of letters and digits in lower case.

Defined results: null and empty texts and items match nothing; repeated rows are found each for itself and
reported once for each doc_id; a null doc_id or item_id is reported as it is; an empty benchmark or table
gives no rows; further columns are ignored. What is broadcast is bounded by the benchmark, not by the corpus, and a
benchmark of more than SLICE characters is searched for in slices; the latent dimensions go down where their table
would exceed TABLE numbers.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

DIRECT, LOOSE, ANSWER, ANSWERED = 0.7, 0.5, 5, 0.8
#: Candidates by cosine, and what they need; terms that an item is expanded by, and their least weight.
NEAR, FAINT, SAID, EXPANDED, TRIM = 0.5, 0.4, 0.6, 64, 0.1
#: What matches an item lies in a stretch of so many times its length.
STRETCH = 1.5
#: A term of more than this share of the items is no column, unless an item has too few others.
COMMON, LEAST = 0.02, 6
#: Leading singular vectors of the corpus; latent dimensions at most, the items' own included.
LEADING, RANK = 64, 512
#: Characters of a slice of the benchmark; numbers in the table of terms by latent dimensions.
SLICE, TABLE = 8_000_000, 16_000_000


#: Bytes that end a word: all of ASCII but letters and digits.
BETWEEN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters and digits (and of all that isn't ASCII), in lower case."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(BETWEEN).split()


class Benchmark:
    """The items' words, columns and windows."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items = [(i, w) for i, w in ((i, terms_of(t)) for i, t in items) if w]
        count: dict[bytes, int] = {}
        for _, w in self.items:
            for x in set(w):
                count[x] = count.get(x, 0) + 1
        most = max(1.0, COMMON * len(self.items))
        columns: dict[bytes, int] = {}
        for _, w in self.items:
            own, covered = Counter(w), 0
            for k, x in enumerate(sorted(own, key=lambda x: (count[x], x))):
                if count[x] <= most or k < LEAST or covered <= (1 - DIRECT) * len(w):
                    columns.setdefault(x, len(columns))
                covered += own[x]
        self.columns = columns
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)
        #: the stride of each item's class: the power of two that a stretch of it fits in
        self.strides = np.array([max(16, 1 << int(STRETCH * len(w)).bit_length()) for _, w in self.items], np.int64)
        self.stride = int(np.sort(self.strides)[len(self.strides) // 2]) if self.items else 16
        #: the answer of each item: its last words that are columns
        self.answers = [[x for x in w if x in columns][-ANSWER:] for _, w in self.items]
        # the matrix of items by columns, as lists of its cells: item, column, times in the item and in its answer
        cells = []
        for k, (_, w) in enumerate(self.items):
            said = Counter(self.answers[k])
            cells += [(k, columns[x], n, said[x]) for x, n in Counter(w).items() if x in columns]
        self.at, self.col, self.times, self.said = np.array(cells, np.int64).reshape(-1, 4).T
        self.counts, self.answer_counts = (np.bincount(self.at, x, len(self.items)) for x in (self.times, self.said))

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Of each item: the sum of the rows of its columns."""
        return np.add.reduceat(rows[self.col], np.flatnonzero(np.diff(self.at, prepend=-1)))


class Cells:
    """The hits (words that have a column) of a batch of documents, by blocks of one stride.

    A passage is two blocks of one document that follow each other (or its only one); it is numbered as its
    first block.
    """

    def __init__(self, texts: list[str | None], columns: dict[bytes, int], stride: int):
        self.words = [terms_of(t) for t in texts]
        n = np.fromiter(map(len, self.words), np.int64, len(texts))
        term = np.fromiter(map(columns.get, chain.from_iterable(self.words), repeat(-1)), np.int32, int(n.sum()))
        self.at = np.flatnonzero(term >= 0)
        self.term = term[self.at]
        self.n = n
        self.deal(stride)

    def deal(self, stride: int) -> None:
        """Blocks of another stride."""
        n, at = self.n, self.at
        blocks = np.where(n > 0, np.maximum(2, -(-n // stride)), 0)
        self.first = np.cumsum(blocks) - blocks  # block of each document
        doc = np.repeat(np.arange(len(n)), n)[at]
        self.block = self.first[doc] + (at - (np.cumsum(n) - n)[doc]) // stride
        total = int(blocks.sum())
        self.opens = np.ones(total, bool)  # blocks with which a passage begins: all but the last of a document
        self.opens[(self.first + blocks - 1)[n > 0]] = False
        self.passages = int(self.opens.sum())
        self.start = np.searchsorted(self.block, np.arange(total + 2))

    def pairs(self, n: int) -> np.ndarray:
        """Passage * n + column, once for each column of each passage."""
        here, before = self.opens[self.block], self.block > 0
        before[before] = self.opens[self.block[before] - 1]
        return np.unique(np.concatenate([self.block[here] * n + self.term[here], (self.block[before] - 1) * n + self.term[before]]))


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage and index of every hit of every passage, in order."""
    size = last - first
    start = np.cumsum(size) - size
    return np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(start - first, size)


def gathered(docs: DataFrame, bench: Benchmark, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of passages, passages with each column, and C'(C X), over all documents."""
    n, width = x.shape
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast((bench.columns, bench.stride, x))

    def run(batches):
        columns, stride, x = share.value
        total, df, y = 0, np.zeros(n), np.zeros((n, width))
        for b in batches:
            c = Cells(b.column("text").to_pylist(), columns, stride)
            total += c.passages
            if not len(c.term):
                continue
            df += np.bincount(c.pairs(n) % n, minlength=n)
            sums = np.zeros((len(c.opens) + 1, width), np.float32)
            edges = np.flatnonzero(np.diff(c.block, prepend=-1))
            sums[c.block[edges]] = np.add.reduceat(x[c.term], edges)
            passage = np.where(c.opens[:, None], sums[:-1] + sums[1:], 0)
            passage[1:] += passage[:-1].copy()  # of each block: the sums of both passages that hold it
            order = np.argsort(c.term, kind="stable")
            term = c.term[order]
            edges = np.flatnonzero(np.diff(term, prepend=-1))
            y[term[edges]] += np.add.reduceat(passage[c.block[order]], edges)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int32()), pa.array([float(total), *df[some].tolist()], pa.float64()), pa.array([None, *y[some].astype(np.float64)], pa.list_(pa.float64()))], names=["col", "n", "y"])

    rows = docs.select("text").where("text is not null").mapInArrow(run, "col int, n double, y array<double>")
    sums = rows.groupBy("col").agg(F.sum("n").alias("n"), *[F.sum(F.get("y", k)).alias(f"y{k}") for k in range(width)]).collect()
    total, df, y = 0, np.zeros(n), np.zeros((n, width))
    for r in sums:
        if r[0] < 0:
            total = int(r[1])
        else:
            df[r[0]], y[r[0]] = r[1], r[2:]
    return total, df, y


def singular(bench: Benchmark, idf: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of the passages' TF-IDF rows, from the sketch; and the latent space (terms x rank) of these and the items' rows."""
    z = idf[:, None] * y
    core = (x / idf[:, None]).T @ z  # the scaled rows have met the random matrix x / idf
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(1e-9 * values.max(initial=0.0), 1e-12)
    half = z @ (vectors[:, keep] / np.sqrt(values[keep]))
    leading = np.linalg.svd(half, full_matrices=False)[0] if keep.any() else np.zeros((len(idf), 0))
    n, rank = len(idf), max(1, min(RANK, TABLE // len(idf)))
    weight = idf[bench.col] / np.sqrt(np.bincount(bench.at, idf[bench.col] ** 2, len(bench.items)))[bench.at]
    if len(bench.items) <= rank:
        own = np.zeros((n, len(bench.items)))
        own[bench.col, bench.at] = weight
    else:  # a sketch of the items' rows
        mixed, own = np.random.default_rng(12).standard_normal((len(bench.items), rank)) / np.sqrt(rank), np.zeros((n, rank))
        for i in range(0, len(bench.at), 1 << 14):
            j = slice(i, i + (1 << 14))
            np.add.at(own, bench.col[j], weight[j, None] * mixed[bench.at[j]])
    u, s, _ = np.linalg.svd(np.hstack([leading, own]), full_matrices=False)
    return leading, u[:, s > 1e-6 * s.max(initial=1.0)][:, :rank]


def expanded(bench: Benchmark, idf: np.ndarray, leading: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (item, column, weight) of the items' unit rows after expansion, own columns first."""
    weight = idf[bench.col] / np.sqrt(np.bincount(bench.at, idf[bench.col] ** 2, len(bench.items)))[bench.at]
    along = np.add.reduceat(weight[:, None] * leading[bench.col], np.flatnonzero(np.diff(bench.at, prepend=-1)))
    own = weight + np.einsum("ij,ij->i", along[bench.at], leading[bench.col])
    at, col, more = [bench.at], [bench.col], [own]
    first = np.searchsorted(bench.at, np.arange(len(bench.items) + 1))
    for i in range(len(bench.items)):
        row = leading @ along[i]
        mine = slice(first[i], first[i + 1])
        row[bench.col[mine]] = 0
        top = np.argpartition(row, -EXPANDED)[-EXPANDED:] if len(row) > EXPANDED else np.arange(len(row))
        top = np.sort(top[row[top] >= TRIM * own[mine].max()])
        at.append(np.full(len(top), i))
        col.append(top)
        more.append(row[top])
    at, col, more = map(np.concatenate, (at, col, more))
    return at, col, more / np.sqrt(np.bincount(at, more**2, len(bench.items)))[at]


def subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    where: dict[bytes, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def possible(shared: np.ndarray, said: np.ndarray, columns: np.ndarray, answer: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether a pair can be a leak: shared, said are the words of the item and of its answer that are columns the passage has; the item's other words may all be there."""
    most = (shared + words - columns) / words + 1e-9
    return (most >= DIRECT) | ((most >= LOOSE) & (said + 1e-9 >= ANSWERED * answer) & (answer > 0))


def judged(item: list[bytes], answer: list[bytes], passage: list[bytes], near: bool = False) -> tuple[float, float, bool]:
    """Share of the item, share of its answer, and whether it is a leak: the best of all stretches little longer than the item. near: a candidate by cosine."""
    best, most = (0.0, 0.0, False), int(STRETCH * len(item)) + 1
    step = max(1, len(item) // 8)
    for i in range(0, max(1, len(passage) - most + step), step):
        part = passage[i : i + most]
        share = subsequence(item, part) / len(item)
        if share > best[0]:
            said = subsequence(answer, part) / len(answer) if answer and share >= FAINT else 0.0
            best = share, said, share >= DIRECT or (share >= LOOSE and said >= ANSWERED) or (near and share >= FAINT and said >= SAID)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (number of its first word), cosine, lcs (share of the item), answer (share), the best passage of each pair."""
    spark = docs.sparkSession
    ready(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    out, slices = None, -(-size // SLICE)
    for k in range(slices):
        some = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k) if slices > 1 else items
        found = _leaks(docs, Benchmark([(r.item_id, r.text) for r in some.collect()]))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


SCHEMA = "doc_id bigint, item_id bigint, start bigint, cosine double, lcs double, answer double"


def _leaks(docs: DataFrame, bench: Benchmark) -> DataFrame:
    spark = docs.sparkSession
    if not bench.items:
        return spark.createDataFrame([], SCHEMA)
    x = np.random.default_rng(11).standard_normal((len(bench.columns), min(LEADING, len(bench.columns)))).astype(np.float32)
    passages, df, y = gathered(docs, bench, x)
    idf = np.log((2.0 + passages) / (1.0 + df))
    leading, v = singular(bench, idf, y, x.astype(np.float64))
    terms = (idf[:, None] * v).astype(np.float32)
    queries = bench.sums(terms)
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    sizes = bench.counts, bench.answer_counts, bench.lengths
    # for each class: its stride, and the cells of its items, by term: item, times in it and its answer (0 for expansions), weight
    at, col, weight = expanded(bench, idf, leading)
    none = np.zeros(len(at) - len(bench.at))
    times, said = np.concatenate([bench.times, none]), np.concatenate([bench.said, none])
    classes, by_col = [], np.argsort(col, kind="stable")
    for stride in np.unique(bench.strides).tolist():
        cells = by_col[bench.strides[at[by_col]] == stride]
        classes.append((stride, at[cells], np.searchsorted(col[cells], np.arange(len(bench.columns) + 1)), (times[cells], said[cells], weight[cells])))
    # own TF-IDF rows: squares of the items' norms, and of the columns' weights
    squares = idf**2
    lengths = bench.sums(squares)
    share = spark.sparkContext.broadcast((bench.columns, bench.items, bench.answers, terms, queries, classes, sizes, squares, lengths, idf))

    def dealt(batches, columns, classes):
        for b in batches:
            c = Cells(b.column("text").to_pylist(), columns, classes[0][0])
            for one in classes:
                c.deal(one[0])
                yield b, c, one

    def run(batches):
        columns, items, answers, terms, queries, classes, sizes, squares, lengths, idf = share.value
        n = len(columns) + 1
        for b, c, (stride, item, where, weights) in dealt(batches, columns, classes):
            pairs = c.pairs(n)
            if not len(pairs):
                continue
            word, place = pairs % n, pairs // n
            first = np.searchsorted(pairs, np.arange(len(c.opens) + 1) * n)  # columns of each passage
            norm = np.sqrt(np.bincount(place, squares[word], len(c.opens)))
            meet, k = spread(where[word], where[word + 1])
            met, back = np.unique(place[meet] * len(items) + item[k], return_inverse=True)
            shared, said = (np.bincount(back, w[k], len(met)) for w in weights[:2])
            near = np.bincount(back, weights[2][k] * idf[word[meet]], len(met)) >= NEAR * norm[met // len(items)]
            take = near | possible(shared, said, *(x[met % len(items)] for x in sizes))
            met, near = met[take], near[take]
            if not len(met):
                continue
            at, q = met // len(items), met % len(items)
            cos = np.empty(len(met), np.float32)
            for i in range(0, len(met), 4096):
                j = slice(i, i + 4096)
                part, back = np.unique(at[j], return_inverse=True)
                who, every = spread(first[part], first[part + 1])
                z = np.add.reduceat(terms[word[every]], np.flatnonzero(np.diff(who, prepend=-1)))
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                latent = np.einsum("ij,ij->i", z[back], queries[q[j]])
                whole = norm[at[j]] ** 2 * lengths[q[j]]
                # squares of the columns that both have
                own, cell = spread(first[at[j]], first[at[j] + 1])
                low, high = where[word[cell]], where[word[cell] + 1]
                pair, held = spread(low, high)
                common = np.bincount(own[pair], squares[word[cell[pair]]] * ((item[held] == q[j][own[pair]]) & (weights[0][held] > 0)), len(q[j]))
                cos[j] = np.maximum(latent, common / np.sqrt(np.maximum(whole, 1e-24)))
            ids, rows = b.column("doc_id").to_pylist(), []
            owner = np.searchsorted(c.first, at, "right") - 1
            for j in range(len(met)):
                d = int(owner[j])
                while not c.words[d]:
                    d -= 1
                begin = int(at[j] - c.first[d]) * stride
                lcs, answer, leak = judged(items[q[j]][1], answers[q[j]], c.words[d][begin : begin + 2 * stride], bool(near[j]))
                if leak:
                    rows.append((ids[d], items[q[j]][0], begin, float(cos[j]), lcs, answer))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "start", "cosine", "lcs", "answer"])

    found = docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
    best = F.max_by(F.struct("start", "cosine", "lcs", "answer"), F.struct("lcs", "answer", -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
