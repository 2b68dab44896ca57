"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D. bytes.split() splits on exactly these.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, as in tests, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        folder = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = f"file://{tempfile.mkdtemp(prefix='skyplate-')}"
            sc.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders that materialize() wrote in this process.
WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process. Call it once results have been written: frames that read them end with it."""
    discard(spark, *list(WRITTEN))


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts. A null key has fold null."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def mixed(key: Column, seed: int) -> Column:
    """A seeded hash of the key, from 0 up to 2 ** 63."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1)


def share_below(most: int, n: Column) -> Column:
    """The value below which a hash from 0 up to 2 ** 63 lies for about `most` of n rows: a bound by a parameter that needs no ranking."""
    return F.when(n > most, (F.lit(float(most) * 2**63) / n).cast("bigint")).otherwise(F.lit((1 << 63) - 1))


def sampled_ids(labels: DataFrame, key: str, label: str, most: int, seed: int, by_label: bool = True) -> DataFrame:
    """About `most` (key, label) rows per label value, or in all, those whose seeded hash is small enough for that share.

    Bounded by a parameter, so that the result can be broadcast and what is fitted on it can be collected.
    Repeated keys count once, with their largest label; null keys and labels are left out.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias(label))
    group = F.col(label) if by_label else F.lit(0)
    counts = rows.groupBy(group.alias("_by")).agg(F.count(F.lit(1)).alias("_n")).select("_by", share_below(most, F.col("_n")).alias("_cut"))
    few = rows.join(F.broadcast(counts), group == F.col("_by")).where(mixed(F.col(key), seed) <= F.col("_cut"))
    return few.select(key, label)


def blobs(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) ranges of at most `most` bytes each, or of one item that is larger."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by \\n; start of each text, with the end of all as the last."""
    data = np.frombuffer(b"\n".join(docs) + b"\n", dtype=np.uint8)
    starts = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=starts[1:])
    return data, starts


def totals(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags in each range between consecutive bounds."""
    run = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=run[1:])
    return np.diff(run[bounds])


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))
