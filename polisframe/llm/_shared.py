"""What the operators share: shared storage, Arrow batches cut to size, whole groups of a sorted stream, hashing."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at a time inside a task: Python's words of it take about ten times as much.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(configured)
    return str(configured)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared storage and read it again: cuts lineage, survives lost executors.

    ``release``: the shuffle files of this write go as soon as it has ended, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"llm-{uuid.uuid4().hex}.parquet")
    before = spark.conf.get(_RELEASE, None)
    if release:
        spark.conf.set(_RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def text_column(name: str = "text") -> Column:
    """A text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows with about ``SLICE_BYTES`` of text (one row at least)."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Cut a stream sorted by ``key`` (not null) so that every batch holds whole groups.

    Memory: one batch and the largest group; callers bound their groups.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1].as_py()
        if held and keys[0].as_py() == last and held[-1].column(key)[0].as_py() == last:
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(values != last)[-1]) + 1 if (values != last).any() else 0
        done = [*held, batch.slice(0, cut)] if cut else held
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64 (public domain): a fixed, well mixed bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), fixed by the 64-bit values given."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def byte_alphabet() -> list[str]:
    """The stand-in of each byte in byte-level vocabularies: printable Latin-1 characters stand for themselves, U+0100 and
    on in order for the others."""
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 else chr(next(spare)) for b in range(256)]
