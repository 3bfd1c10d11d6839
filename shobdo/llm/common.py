"""What the operators of this subpackage share: tables, the shared folder, checkpoints, Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where that is unset a temporary one is set if this machine runs everything
    (master local); on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="shobdo-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """A file of the shared folder, written through the file system that the folder names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
    finally:
        out.close()
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and cuts the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back with its columns prunable."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"shobdo-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of items whose sizes sum to at most `most` (or one larger item)."""
    out, k = [], 0
    while k < len(sizes):
        end, total = k, 0
        while end < len(sizes) and (end == k or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        out.append((k, end))
        k = end
    return out


#: Code points that the word operators hold at a time, which bounds a worker's memory
BLOCK_CHARS = 2_000_000


def text_blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> list[tuple[int, int]]:
    return blocks([len(t or "") for t in texts], most)


#: Bytes of text that one bucket of packed n-grams stands for, and the least number of buckets
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 48


def bucket_count(df: DataFrame) -> tuple[int, int]:
    """Texts, and buckets in proportion to their bytes, which a scan of the one column sums."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    return n, max(LEAST_BUCKETS, (size or 0) // BUCKET_BYTES)
