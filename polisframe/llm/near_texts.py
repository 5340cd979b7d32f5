"""Near-duplicate texts by five-word shingles: a link is an exact Jaccard likeness of at least 0.8.

A text is the set of the XXH64 hashes of its word shingles; texts of one set fall together first. Two sets share one of
their ``MINIMA`` least shingles but for about (1 - likeness)^MINIMA, so each set goes to the shards of its least
shingles. A shard is cut into blocks of bounded size; a block's SimHashes are a BK-tree, in which the sets look for those within ``RADIUS`` bits.
Those of a fitting size are candidates; a pair that shares several shards is left to the least of them. Only sets that have a candidate are sent on, with their text, and
candidates are linked by the sets themselves. Pairs that earlier links of the task connect are not looked at, so a group
of near copies costs about one comparison per text, and tasks put out spanning forests, never the pairs of a group.

SimHashes only screen: at a likeness of 0.8 they differ in 9.7 of 64 bits on average, in more than 12 for one pair in six.
``RADIUS`` leaves out fewer than one pair in a million; sets of fewer than ``SCREENED`` shingles search the whole tree, as theirs scatter more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisframe.llm._shared import starts_of, stored, text_column, text_slices, whole_groups
from polisframe.llm.simhash_tree import SEED, BKTree, shingle_hashes, simhash
from polisframe.operators.components import components

SHINGLE, JACCARD = 5, 0.8
MINIMA, RADIUS, SCREENED = 10, 25, 64
#: Most sets of a block, and about the most shingles of a block of several.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Sets that descend a tree together.
SEARCHED = 128


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _marked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        content, sizes, bits, minima = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(text, size)
            content.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            sizes.append(len(found))
            bits.append(simhash(found))
            minima.append(found[:MINIMA].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("tag"), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
            pa.array(np.array(bits, np.uint64).view(np.int64)), pa.array(minima, pa.list_(pa.int64()))], ["doc_id", "tag", "content", "size", "bits", "minima"])


def text_tag(name: str = "text") -> Column:
    return F.unhex(F.md5(text_column(name)))


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_tag().alias("tag"), text_column().alias("text"))


def _minima_of(column: pa.Array) -> np.ndarray:
    """One row per set; the places of missing minima hold the row's first."""
    counts = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().view(np.uint64)
    first = np.cumsum(counts) - counts
    return flat[first[:, None] + np.where(np.arange(MINIMA) < counts[:, None], np.arange(MINIMA), 0)]


def _candidates(i: int, others: np.ndarray, key: int, size: np.ndarray, bits: np.ndarray, minima: np.ndarray, jaccard: float) -> np.ndarray:
    """Those of ``others`` that may link with set i and share no smaller shard with it."""
    small, large = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
    fit = (small >= jaccard * large) & ((small < SCREENED) | (np.bitwise_count(bits[i] ^ bits[others]) <= RADIUS))
    others = others[fit]
    before = minima[i][minima[i] < key]
    if len(others) and len(before):
        others = others[~np.isin(minima[others], before).any(axis=1)]
    return others


def _pairs(batch: pa.RecordBatch, a: int, b: int, jaccard: float) -> Iterator[tuple[int, np.ndarray]]:
    """(set, candidates), numbered from a, of the task in the rows from a to b."""
    part = batch.slice(a, b - a)
    key = part.column("key")[0].as_py() % 2**64
    size, bits = part.column("size").to_numpy(), part.column("bits").to_numpy().view(np.uint64)
    minima = _minima_of(part.column("minima"))
    second = part.column("second").to_numpy(zero_copy_only=False)
    split = int(np.argmax(second)) if second.any() else b - a
    whole = split == b - a
    start = 0 if whole else split
    # sets of one SimHash are one node
    points, at = np.unique(bits[start:], return_inverse=True)
    members, held = np.argsort(at, kind="stable") + start, np.bincount(at, minlength=len(points))
    first, tree = np.cumsum(held) - held, BKTree(points)
    # a set none of whose fitting partners is too small to be screened keeps to the radius
    radius = np.where(jaccard * size >= SCREENED, RADIUS, 64)
    for low in range(0, split, SEARCHED):
        high = min(low + SEARCHED, split)
        query, node = (np.concatenate(x) for x in zip(*tree.near(bits[low:high], radius[low:high]), strict=True))
        query, many, begin = query + low, held[node], first[node]
        other = members[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        query = np.repeat(query, many)
        if whole:
            query, other = query[other > query], other[other > query]
        order = np.lexsort((other, query))
        query, other = query[order], other[order]
        bounds = np.append(starts_of(query), len(query))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            found = _candidates(int(query[x]), other[x:y], np.uint64(key), size, bits, minima, jaccard)
            if len(found):
                yield int(query[x]), found


def _screened(batches: Iterator[pa.RecordBatch], jaccard: float) -> Iterator[pa.RecordBatch]:
    """The rows that have a candidate in their task."""
    for batch in whole_groups(batches, "task"):
        bounds = np.append(starts_of(batch.column("task").to_numpy()), batch.num_rows)
        wanted = np.zeros(batch.num_rows, bool)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            for i, found in _pairs(batch, a, b, jaccard) if b - a > 1 else ():
                wanted[a + i] = True
                wanted[a + found] = True
        yield batch.filter(pa.array(wanted))


def _linked(batches: Iterator[pa.RecordBatch], jaccard: float, shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in whole_groups(batches, "task"):
        bounds = np.append(starts_of(batch.column("task").to_numpy()), batch.num_rows)
        content, links = batch.column("content").to_numpy(), []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            group = np.arange(b - a)
            sets: dict[int, np.ndarray] = {}

            def held(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingle_set(batch.column("text")[a + i].as_py(), shingle)  # noqa: B023
                return sets[i]

            for i, found in _pairs(batch, a, b, jaccard) if b - a > 1 else ():
                for j in found.tolist():
                    if group[i] == group[j]:
                        continue
                    both = len(np.intersect1d(held(i), held(j), assume_unique=True))
                    if both >= jaccard * (len(held(i)) + len(held(j)) - both):
                        links.append((content[a + i], content[a + j]))
                        group[group == group[j]] = group[i]
        found = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], ["a", "b"])


def links(docs: DataFrame, classes: DataFrame, jaccard: float, shingle: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links of contents that connect all of ``classes`` (content, head, size, bits, minima) that are alike."""
    sharded = classes.select("content", "size", "bits", "minima", F.explode("minima").alias("key"))
    # shards of one set hold no pair; crowded or heavy ones are cut by a hash of the content
    crowd = sharded.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).where("n > 1")
    parts = F.greatest(F.when(F.col("n") <= block, 1).otherwise(F.ceil(F.col("n") / F.lit(block // 2))),
                       F.least(F.ceil(F.col("weight") / F.lit(BLOCK_SHINGLES)), F.col("n"))).cast("int")
    cut = sharded.join(crowd, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("content", "key"), F.col("parts")).cast("int"))
    # part i meets itself and each later part
    tasks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "content", "size", "bits", "minima", "key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("task"),
        (F.col("part") > F.col("other")).alias("second"))
    wanted = stored(tasks.repartition("task").sortWithinPartitions("task", "second", "content").mapInArrow(
        lambda batches: _screened(batches, jaccard), tasks.schema))
    heads = wanted.select("content").distinct().join(classes.select("content", "head.doc_id", "head.tag"), "content")
    texts = _tagged(docs).join(heads, ["doc_id", "tag"]).select("content", "text").dropDuplicates(["content"])
    return wanted.join(texts, "content").repartition("task").sortWithinPartitions("task", "second", "content").mapInArrow(
        lambda batches: _linked(batches, jaccard, shingle), "a bigint, b bigint")


def near_texts(docs: DataFrame, jaccard: float = JACCARD, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, tag, root, component_id) for every row of ``docs`` (doc_id, text); ids are not null.

    ``tag`` is the MD5 of the text, ``root`` the same for all rows of one component, and for no others; ``component_id`` is
    the smallest doc_id of the component. Null and texts without words are one component.
    """
    marked = stored(_tagged(docs).mapInArrow(
        lambda batches: _marked(batches, shingle), "doc_id bigint, tag binary, content bigint, size int, bits bigint, minima array<bigint>"))
    classes = stored(marked.groupBy("content").agg(F.min(F.struct("doc_id", "tag")).alias("head"), *[F.any_value(c).alias(c) for c in ("size", "bits", "minima")]))
    found = components(stored(links(docs, classes, jaccard, shingle, block)))
    rooted = classes.select("content", F.col("head.doc_id").alias("least")).join(found.withColumnsRenamed({"id": "content", "component": "root"}), "content", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "content"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_content = rooted.join(least, "root").select("content", "root", "component_id")
    return marked.join(of_content, "content").select("doc_id", "tag", "root", "component_id")
