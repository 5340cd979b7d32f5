"""Session settings, reliable checkpoints and row numbering shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when the split costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows in memory are some times larger than their files, which counts before a broadcast
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # a side whose partitions are all as small as AQE wants them is hashed, so that the other side is neither sorted nor spilled
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # methods beyond this are never compiled by the JVM; such a stage runs operator by operator, whose methods are small
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # rows that meet nothing in a filtered side are dropped before the shuffle: one Bloom filter of 16 MB a side, however large that is;
    # it lets through 5 % at 20 million keys and more beyond them, but never drops a row that meets one
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "16MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "8GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "20000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "20000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "134217728",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "134217728",
    "spark.sql.optimizer.runtimeFilter.number.threshold": "64",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators rely on; cluster sizing stays as configured."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; pick a scratch folder only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="polisframe-checkpoint-")
    context.setCheckpointDir(configured)


def checkpointed(df: DataFrame, layout: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that it survives lost executors.

    It is written as compressed columns; Spark's own checkpoint files hold whole rows uncompressed, and are only used where order and partitions of
    the rows must stay (``layout``).
    """
    if layout:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    path = shared_folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small catalogue frame as a local relation: its size is known to the planner and no Python worker is needed."""
    fields = to_arrow_schema(T._parse_datatype_string(schema))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), schema)


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return local_frame(spark, [], schema)


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no", start: int = 1,
                partitions: int | None = None) -> DataFrame:
    """Add consecutive numbers in ``order`` without a single-partition window.

    Rows are range-partitioned and sorted, each partition counts its own rows, and the running total of the
    partitions before it is added. The numbered rows are checkpointed because the partition layout must not change
    between counting and adding; the offsets are one row per partition. ``order`` should end in a unique column.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    return _with_offsets(checkpointed(spread.withColumn("_mono", F.monotonically_increasing_id())), name, start)


def number_rows_any_order(df: DataFrame, name: str = "row_no", start: int = 1) -> DataFrame:
    """Consecutive numbers in the rows' present partition order; no shuffle of the data."""
    return _with_offsets(checkpointed(df.withColumn("_mono", F.monotonically_increasing_id())), name, start)


def _with_offsets(numbered: DataFrame, name: str, start: int) -> DataFrame:
    # monotonically_increasing_id = partition number in the upper bits, position in the lower 33
    spark = numbered.sparkSession
    part = F.shiftright("_mono", 33)
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    counts = numbered.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # one row per partition
    offsets, total = {}, start
    for row in counts:
        offsets[row["_part"]] = total
        total += row["count"]
    if not offsets:
        return numbered.withColumn(name, F.lit(None).cast("bigint")).drop("_mono")
    table = local_frame(spark, list(offsets.items()), "_part int, _offset bigint")
    return (
        numbered.withColumn("_part", part.cast("int"))
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_mono", "_part", "_offset")
    )


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder in the storage that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


#: Rows of a first page that the tasks merge among themselves; deeper pages are cut out of ranges.
FIRST_ROWS = 10_000


def page_rows(df: DataFrame, order: list[Column], limit: int | None, start: int = 0, first_rows: int = FIRST_ROWS) -> DataFrame:
    """Rows ``start + 1 … start + limit`` in ``order``, sorted.

    A page within the first ``first_rows`` is a lazy top-k. Any other is cut out of the sorted rows: they are written once, one folder a range of the
    order, the rows of each range are counted, and only the ranges that the page meets are read. ``order`` should end in a unique column.
    """
    if limit is not None and start + limit <= first_rows:
        out = df.orderBy(*order)
        return (out.offset(start) if start else out).limit(limit)
    spark = df.sparkSession
    folder = shared_folder(spark, "page")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed.withColumn("_range", F.shiftright("_place", 33).cast("int")).write.partitionBy("_range").parquet(folder)
    ranges = spark.read.schema(T.StructType([*placed.schema, T.StructField("_range", T.IntegerType())])).parquet(folder)
    met, before = F.lit(False), 0
    row = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    end = None if limit is None else start + limit
    inner = []
    for number, size in sorted(map(tuple, ranges.groupBy("_range").count().collect())):  # a row a range
        first, last = max(0, start - before), size if end is None else min(size, end - before)
        if (first, last) == (0, size):
            inner.append(number)
        elif first < last:
            met |= (F.col("_range") == number) & (row >= first) & (row < last)
        before += size
    if inner:
        met |= F.col("_range").between(inner[0], inner[-1])
    return ranges.where(met).orderBy("_place").drop("_place", "_range")


def after_row(order: list[tuple[str, str]], values: list) -> Column:
    """Whether a row comes after the one with these ``values`` in ``order`` ((column, asc or desc) …); nulls are last ascending and first descending.

    A filter for the next page that needs no offset: it is pushed down to the files.
    """
    out = F.lit(False)
    for (name, direction), value in reversed(list(zip(order, values, strict=True))):
        c = F.col(name)
        if direction == "asc":
            later = F.lit(False) if value is None else c.isNull() | (c > F.lit(value))
        else:
            later = c.isNotNull() if value is None else c < F.lit(value)
        out = F.coalesce(later, F.lit(False)) | (c.eqNullSafe(F.lit(value)) & out)
    return out
