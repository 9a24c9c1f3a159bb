"""What the operators of this subpackage share: tables, words, and cutting lineage in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship

MASK64 = (1 << 64) - 1
_OWN_DIR: list[str] = []
_TRASH: list[tuple[str, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession, rows_per_batch: int = 400) -> None:
    """Ship the code and keep Arrow batches small: texts can be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))


@contextmanager
def rows_per_batch(spark: SparkSession, n: int) -> Iterator[None]:
    """For plans that run inside: Arrow batches of n rows; the session's own value comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def together(batches: Iterable[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold about size bytes: what a batch repeats is then worked on once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in the one that driver and executors share. Where none is set: beside the warehouse's tables, or a temporary one if all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_temporary_tables"
    if not base:
        if not _OWN_DIR:
            _OWN_DIR.append(tempfile.mkdtemp(prefix="llm_"))
        base = f"file://{_OWN_DIR[0]}"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_dir(spark)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _TRASH.append((spark.sparkContext.applicationId, path))
    out = spark.read.schema(schema).parquet(path)
    out.folder = path
    return out


def drop(spark: SparkSession, *dfs: DataFrame) -> None:
    """Delete the files that cut() wrote for these, when nothing reads them any more; other tables are left alone."""
    for df in dfs:
        folder = getattr(df, "folder", None)
        if isinstance(folder, str):
            delete(spark, folder)
            _TRASH[:] = [x for x in _TRASH if x[1] != folder]


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done; else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete all that cut() has left: for callers who know that earlier results are written."""
    app = spark.sparkContext.applicationId
    for a, path in _TRASH:
        if a == app:
            delete(spark, path)
    _TRASH.clear()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text as UTF-8 bytes; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 4096) * 2
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(m, base, np.uint64), np.full(m, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up), np.cumprod(down))
    return have


def rolling(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of k word hashes: a polynomial modulo 2**64, then mixed."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(base, n + 1)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(h * down[:n], out=s[1:])
    return mix((s[k:] - s[:-k]) * up[: n - k + 1])


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
