"""Tables in the folder that driver and executors share: where a result is read more than once, its lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where none is set, beside the warehouse's tables, or a temporary one if all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_temporary_tables"
    if not base:
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="seqloom_"))
        base = f"file://{_OWN[0]}"
    return f"{base.rstrip('/')}/seqloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df from a table of its own."""
    path, schema = folder(df.sparkSession), df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
