"""Embedding near-duplicates by cross-polytope hashing.

A vector is rotated by three rounds of random signs and the fast Hadamard transform; the hash is the signed axis it is
closest to (Andoni et al., "Practical and optimal LSH for angular distance", 2015). A table joins ``hashes`` of them into one bucket, and
every vector is also put into the next likely buckets (multiprobe). All pairs that share a bucket are verified by
cosine in double precision.

Equal vectors fall together first and only count. Buckets are pre-counted: those of one vector are left out, crowded
ones are cut into blocks that are compared two by two, so no task's input grows with a bucket. A pair that shares several
buckets is counted in the first of them only, so links are counted where they are found: tasks put out
counts per vector and a spanning forest of links, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisframe.llm._shared import mix64, starts_of, stored, whole_groups
from polisframe.llm.simhash_tree import Forest
from polisframe.operators.components import components

TABLES, PROBES, BLOCK = 8, 2, 1024
#: Tables for so many hashes, with as many probes as hashes: at a cosine of 0.95 in 64 dimensions about one pair in 10,000 is missed, or fewer.
TABLES_FOR = {2: TABLES, 3: 10, 4: 12, 5: 16}


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; its length is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def _signs(seed: int, width: int) -> np.ndarray:
    bits = mix64(np.arange(width, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    return np.where(bits >> np.uint64(63), 1.0, -1.0)


def axes(unit: np.ndarray, seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` closest signed axes after the rotation ``seed``, and how far each is behind the first."""
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width))
    x[:, :unit.shape[1]] = unit
    for r in range(3):
        x = hadamard(x * _signs(3 * seed + r, width))
    size = np.abs(x)
    order = np.argsort(-size, axis=1, kind="stable")[:, :most]
    size = np.take_along_axis(size, order, 1)
    return 2 * order + (np.take_along_axis(x, order, 1) < 0), (size[:, :1] - size) ** 2


def buckets(unit: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket keys of each row: ``tables`` x ``probes`` 64-bit numbers, no two of a row alike; vectors of other lengths have others."""
    out = []
    for t in range(tables):
        near = [axes(unit, t * hashes + j, probes) for j in range(hashes)]
        code, behind = np.full((len(unit), 1), unit.shape[1], np.uint64), np.zeros((len(unit), 1))
        for axis, gap in near:  # the most likely combinations, joined hash by hash
            code = (mix64(code)[:, :, None] + axis[:, None, :].astype(np.uint64)).reshape(len(unit), -1)
            behind = (behind[:, :, None] + gap[:, None, :]).reshape(len(unit), -1)
            best = np.argsort(behind, axis=1, kind="stable")[:, :probes]
            code, behind = np.take_along_axis(code, best, 1), np.take_along_axis(behind, best, 1)
        out.append(mix64(code + np.uint64(t << 48)))
    return np.concatenate(out, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _same_width(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch by length of its vectors."""
    size = batch.column(column).value_lengths().to_numpy()
    for n in np.unique(size):
        yield batch.filter(pa.array(size == n)) if (size != n).any() else batch


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keyed(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, probes: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _same_width(whole, "vector"):
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                keys = buckets(_unit(_matrix(part.column("vector"))), tables, hashes, probes)
                ids = np.repeat(part.column("least").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel().view(np.int64))], ["least", "key"])


def _groups(task: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """The places of the rows of each task; should keys of two lengths be equal by chance, of each length of the task."""
    bounds = np.append(starts_of(task), len(task))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for n in np.unique(length[a:b]):
            at = a + np.flatnonzero(length[a:b] == n)
            if len(at) > 1:
                yield at


def _verified(batches: Iterator[pa.RecordBatch], cosine: float, tables: int, hashes: int, probes: int) -> Iterator[pa.RecordBatch]:
    for big in whole_groups(batches, "task"):
        task = big.column("task").to_numpy()
        key = big.column("key").to_numpy().view(np.uint64)
        ids, copies = big.column("least").to_numpy(), big.column("copies").to_numpy()
        second = big.column("second").to_numpy(zero_copy_only=False)
        inner = big.column("inner").to_numpy(zero_copy_only=False)
        vectors = big.column("vector")
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        linked: list[np.ndarray] = []
        for at in _groups(task, vectors.value_lengths().to_numpy()):
            unit = _unit(_matrix(vectors.take(pa.array(at))))
            split = int(np.argmax(second[at])) if second[at].any() else 0
            if split:
                x, y = np.nonzero(unit[:split] @ unit[split:].T >= cosine)
                y = y + split
            elif not inner[at[0]]:
                continue  # the other part is empty
            else:
                x, y = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
            if len(x):
                touched = np.unique(np.concatenate([x, y]))
                row = np.zeros(len(at), np.int64)
                row[touched] = np.arange(len(touched))
                own = np.sort(buckets(unit[touched], tables, hashes, probes), axis=1)
                mine = np.ones(len(x), bool)
                for i in range(0, len(x), 65_536):  # the first bucket that a pair shares counts it
                    p, q = own[row[x[i:i + 65_536]]], own[row[y[i:i + 65_536]]]
                    least = np.full(len(p), np.uint64(0xFFFFFFFFFFFFFFFF))
                    for j in range(p.shape[1]):
                        shared = (q == p[:, j:j + 1]).any(axis=1)
                        least = np.where(shared, np.minimum(least, p[:, j]), least)
                    mine[i:i + 65_536] = least == key[at[0]]
                x, y = x[mine], y[mine]
            if len(x):
                n = np.bincount(x, copies[at][y], len(at)) + np.bincount(y, copies[at][x], len(at))
                hit = np.flatnonzero(n)
                counted.append((ids[at][hit], n[hit].astype(np.int64)))
                forest = Forest(len(at))
                forest.add(x, y)
                linked.append(ids[at][np.array(forest.kept, np.int64).reshape(-1, 2)])
        who = np.concatenate([c[0] for c in counted]) if counted else np.zeros(0, np.int64)
        n = np.concatenate([c[1] for c in counted]) if counted else np.zeros(0, np.int64)
        pairs = np.concatenate(linked) if linked else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(pairs), pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.chunked_array([pa.array(who), pa.array(np.ascontiguousarray(pairs[:, 0]))]).combine_chunks(),
            pa.chunked_array([pa.nulls(len(who), pa.int64()), pa.array(np.ascontiguousarray(pairs[:, 1]))]).combine_chunks(),
            pa.chunked_array([pa.array(n), none]).combine_chunks()], ["a", "b", "n"])


def hashes_for(rows: int) -> int:
    """Hashes per table: two, and one more whenever a bucket would hold more than a few dozen unlike vectors."""
    hashes = 2
    while 128**hashes * 16 < rows:
        hashes += 1
    return hashes


def tables_for(hashes: int) -> int:
    """Tables that keep the miss rate; beyond the measured numbers four more for each hash."""
    return TABLES_FOR.get(max(2, hashes)) or TABLES_FOR[5] + 4 * (hashes - 5)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, tables: int | None = None, hashes: int | None = None,
                 probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Rows link at a cosine of at least ``cosine``, equal vectors always. A null, empty or zero vector, or one with null
    or non-finite components, links with nothing. ``component_id`` is the smallest vec_id reachable, itself included;
    repeated rows and null ids are rows like others, but a null id is never the smallest; other columns are ignored;
    no rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    fit = F.size("vector") > 0
    fit = fit & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & (norm > 0) & (norm < F.lit(float("inf")))
    fit = F.coalesce(fit, F.lit(False))
    # 0.0 and -0.0 are one value
    marked = rows.withColumn("content", F.when(fit, F.sha2(F.to_json(F.transform("vector", lambda x: x + F.lit(0.0))), 256)))
    classes = stored(marked.where("content is not null").groupBy("content").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.any_value("vector").alias("vector")
    ).withColumn("least", F.xxhash64("content")))  # a number of its own for each class, also where ids are null
    hashes = hashes or hashes_for(classes.count())
    probes = probes or max(PROBES, hashes)
    tables = tables or tables_for(hashes)
    keyed = stored(classes.select("least", "vector").mapInArrow(lambda b: _keyed(b, tables, hashes, probes), "least bigint, key bigint"))
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cut = keyed.join(crowd, "key").withColumn("parts", F.when(F.col("n") <= block, 1).otherwise(F.ceil(F.col("n") / (block // 2))).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("least", "key"), F.col("parts")).cast("int"))
    tasks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "least", "key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("task"),
        (F.col("part") > F.col("other")).alias("second"), (F.col("part") == F.col("other")).alias("inner"))
    full = tasks.join(classes.select("least", "copies", "vector"), "least")
    found = stored(full.repartition("task").sortWithinPartitions("task", "second", "least").mapInArrow(
        lambda b: _verified(b, cosine, tables, hashes, probes), "a bigint, b bigint, n bigint"))
    counts = found.where("b is null").groupBy(F.col("a").alias("least")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b"))
    known = classes.select("content", "least", "first", "copies").join(counts, "least", "left").join(
        joined.withColumnsRenamed({"id": "least", "component": "root"}), "least", "left")
    known = known.withColumn("root", F.coalesce("root", "least"))
    smallest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(smallest, "root").select("content", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = marked.select("vec_id", "content").join(known, "content", "left")
    component = F.when(F.col("content").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
