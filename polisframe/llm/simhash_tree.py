"""Near-duplicates by SimHash fingerprints searched in BK-trees.

A fingerprint takes the majority of each bit over the XXH64 hashes of a text's word shingles. Equal fingerprints fall
together first, so groups of exact copies cost nothing. Two fingerprints that differ in at most ``radius`` bits agree in
one of ``radius + 1`` bands, so the shards (band, value) together miss no link. A shard's fingerprints are cut into
blocks of bounded size; a block's tree - children keyed by their Hamming distance to the parent - is sent to the task
of every block of the same shard, whose fingerprints descend it together, only along edges within the radius. A task keeps a spanning forest of the links
it finds, so a crowded shard emits at most one link per fingerprint, yet loses no connection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.llm._shared import starts_of, stored, text_column, text_slices, whole_groups
from polisframe.operators.components import components

SEED = 42
#: Most fingerprints of a block; a shard with more is cut into several, which are searched pair by pair.
BLOCK = 1024


def shingle_hashes(text: str, size: int) -> list[int]:
    """The XXH64 hash of the shingle at each word; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], ends[:-size] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(first, ends[size - 1:].tolist(), strict=True)]


def simhash(hashes: list[int] | np.ndarray) -> int:
    """The majority of each bit; of no hashes 0."""
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[i:i + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        found = np.array([simhash(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "bits"])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, bits) for each row of ``docs`` (doc_id, text): the 64-bit SimHash as a signed long; without words 0."""
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    return wanted.mapInArrow(lambda batches: _fingerprinted(batches, size), "doc_id bigint, bits bigint")


class BKTree:
    """A BK-tree held in arrays; built and searched level by level for many fingerprints at a time."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.points = points
        self.edges = np.full((n, 65), -1, np.int32)
        at, todo = np.zeros(n, np.int64), np.arange(1, n)
        while len(todo):
            gap = np.bitwise_count(points[todo] ^ points[at[todo]]).astype(np.int64)
            child = self.edges[at[todo], gap]
            # of those that would open one edge, the first becomes the child; the rest go on below it
            free = np.flatnonzero(child < 0)
            slot, first = np.unique(at[todo[free]] * 65 + gap[free], return_index=True)
            self.edges.reshape(-1)[slot] = todo[free[first]]
            at[todo] = self.edges[at[todo], gap]
            todo = todo[at[todo] != todo]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, node numbers) of all pairs within the radius, level by level."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(query):
            gap = np.bitwise_count(queries[query] ^ self.points[node]).astype(np.int64)
            hit = gap <= radius
            yield query[hit], node[hit]
            span = np.arange(-radius, radius + 1)
            edge = gap[:, None] + span
            child = np.where((edge >= 0) & (edge <= 64), self.edges[node[:, None], np.clip(edge, 0, 64)], -1)
            row, _ = np.nonzero(child >= 0)
            node = child[child >= 0].astype(np.int64)
            query = query[row]

    def near(self, queries: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``within``, for a radius of each query and for wide ones: visited nodes are followed by lists of their children."""
        parent, length = np.nonzero(self.edges >= 0)
        child = self.edges[parent, length].astype(np.int64)
        count = np.bincount(parent, minlength=len(self.points))
        first = np.cumsum(count) - count
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        while len(query):
            gap = np.bitwise_count(queries[query] ^ self.points[node]).astype(np.int64)
            hit = gap <= radius[query]
            yield query[hit], node[hit]
            size = count[node]
            edge = np.repeat(first[node] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            query = np.repeat(query, size)
            on = np.abs(length[edge] - np.repeat(gap, size)) <= radius[query]
            query, node = query[on], child[edge[on]]


class Forest:
    """Union by array; remembers the links that joined two parts."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links in runs; those inside one part fall away before each run is walked."""
        for i in range(0, len(a), 4096):
            x, y = a[i:i + 4096], b[i:i + 4096]
            root = self.roots()
            apart = root[x] != root[y]
            for p, q in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                u, v = p, q
                while self.parent[u] != u:
                    u = int(self.parent[u])
                while self.parent[v] != v:
                    v = int(self.parent[v])
                if u != v:
                    self.parent[max(u, v)] = min(u, v)
                    self.kept.append((p, q))


def forest_links(own: np.ndarray, other: np.ndarray | None, radius: int, band: int, bands: int) -> np.ndarray:
    """Links that span all parts connected within ``own``, or between ``own`` and ``other``.

    A pair that agrees in several bands is left to the first of them.
    """
    points = own if other is None else np.concatenate([own, other])
    tree, forest = BKTree(own), Forest(len(points))
    queries = own if other is None else other
    shift = 0 if other is None else len(own)
    width = 64 // bands
    for query, node in tree.within(queries, radius):
        a, b = node, query + shift
        keep = a < b
        a, b = a[keep], b[keep]
        if band and len(a):
            # pairs of an earlier shard's fingerprints were met there
            low = (points[a] ^ points[b]) & np.uint64((1 << (band * width)) - 1)
            earlier = np.zeros(len(a), bool)
            for i in range(band):
                earlier |= (low >> np.uint64(i * width)) & np.uint64((1 << width) - 1) == 0
            a, b = a[~earlier], b[~earlier]
        forest.add(a, b)
    kept = np.array(forest.kept, np.int64).reshape(-1, 2)
    return points[kept]


def _searched(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in whole_groups(batches, "task"):
        task = batch.column("task").to_numpy()
        bits = batch.column("bits").to_numpy().view(np.uint64)
        second = batch.column("second").to_numpy(zero_copy_only=False)
        band = batch.column("band").to_numpy()
        bounds = np.append(starts_of(task), len(task))
        found = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a < 2:
                continue
            mine, rest = bits[a:b][~second[a:b]], bits[a:b][second[a:b]]
            if len(mine):
                found.append(forest_links(mine, rest if len(rest) else None, radius, int(band[a]), radius + 1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], ["a", "b"])


def _bands(radius: int) -> list[Column]:
    width = 64 // (radius + 1)
    return [F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("bits", i * width).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
            for i in range(radius + 1)]


def links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all of ``distinct`` (bits, each once) that are within ``radius`` bits of each other."""
    sharded = distinct.select("bits", F.explode(F.array(*_bands(radius))).alias("shard")).select("bits", "shard.*")
    # shards of one fingerprint hold no pair; larger ones than a block are cut by a hash of the fingerprint
    counted = sharded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    cut = (
        sharded.join(counted, ["band", "value"])
        .withColumn("parts", F.ceil(F.col("n") / F.lit(block // 2)).cast("int"))
        .withColumn("part", F.when(F.col("n") <= block, 0).otherwise(F.pmod(F.xxhash64("bits", "band"), F.col("parts"))).cast("int"))
        .withColumn("parts", F.when(F.col("n") <= block, 1).otherwise(F.col("parts")))
    )
    # part i meets itself and each later part: it is the tree there, and the queries of the tasks of earlier ones
    tasks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bits", "band", F.xxhash64("band", "value", F.least("part", "other"), F.greatest("part", "other")).alias("task"),
        (F.col("part") > F.col("other")).alias("second"))
    return tasks.repartition("task").sortWithinPartitions("task", "second", "bits").mapInArrow(
        lambda batches: _searched(batches, radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """(doc_id, bits, component_id) for every row of ``docs`` (doc_id, text).

    Fingerprints of ``size``-word shingles link when at most ``radius`` bits differ; ``component_id`` is the smallest
    doc_id reachable over links, itself included. Null and empty texts have fingerprint 0 and link like any other; a
    null id is kept and joins in, but is never the smallest (a component of null ids only has a null one); repeated
    rows each get their row; other columns are ignored; no rows give no rows.
    """
    marked = stored(fingerprints(docs, size))
    distinct = marked.groupBy("bits").agg(F.min("doc_id").alias("least"))
    found = components(stored(links(distinct.select("bits"), radius)))
    rooted = distinct.join(found.withColumnsRenamed({"id": "bits", "component": "root"}), "bits", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "bits"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_bits = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(of_bits, "bits").select("doc_id", "bits", "component_id")
