"""Document fingerprints by Order MinHash (Marcais et al., "Locality-sensitive hashing for the edit distance", 2019).

A text's k-mers of code points are numbered by their occurrences, so that repeats count. Each of ``sketches`` hash orders selects the
``PICK`` minimal numbered k-mers, keeps them in the order of the text, and hashes the tuple. Two texts agree in a sketch
if they share the minimal k-mers and their order, which makes the share of equal sketches sensitive to edit distance.

``chained`` compares each document with the next one by descending id. Rows go to ranges of ids, cut at
quantiles; every range also gets the first row of the range after it, so one shuffle of the texts is all, and a task
streams its range in order with two texts in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisframe.llm._shared import mix64, text_column, text_slices

#: Code points of a k-mer, sketches of a fingerprint, k-mers of a tuple (the code below holds two).
KMER, SKETCHES, PICK = 8, 32, 2

_ADD = mix64(np.arange(1, 1025, dtype=np.uint64))
_TIMES = mix64(np.arange(2001, 3025, dtype=np.uint64)) | np.uint64(1)


def numbered_kmers(text: str, k: int = KMER) -> np.ndarray:
    """A 64-bit hash of every k-mer and its occurrence number, in the order of the text; of a shorter text one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(points):
        return points
    k = min(k, len(points))
    n = len(points) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= np.uint64(0x100000001B3)
        h += points[j:j + n]
    h = mix64(h)
    if n < 1 << 24:  # hash and place in one number: a plain sort then numbers the occurrences
        place = np.sort((h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64))
        at, value = (place & np.uint64((1 << 24) - 1)).astype(np.int64), place >> np.uint64(24)
        h = h >> np.uint64(24)
    else:
        at = np.argsort(h, kind="stable")
        value, h = h[at] >> np.uint64(24), h >> np.uint64(24)
    index = np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], value[1:] != value[:-1]]), index, 0))
    occurrence = np.empty(n, np.uint64)
    occurrence[at] = (index - first).astype(np.uint64)
    return mix64(h + (occurrence << np.uint64(40)))


def sketch(text: str, k: int = KMER, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint: one 32-bit hash per sketch; of the empty text zeros."""
    h = numbered_kmers(text, k)
    if not len(h):
        return np.zeros(sketches, np.uint32)
    tuples = np.zeros((2, sketches), np.uint64)
    step = max(1, 16_384 // len(h))
    for s in range(0, sketches, step):
        e = min(sketches, s + step)
        order = (h[None, :] ^ _ADD[s:e, None]) * _TIMES[s:e, None]
        row = np.arange(e - s)
        a = order.argmin(axis=1)
        if len(h) == 1:
            tuples[0, s:e] = h[a]
            continue
        order[row, a] = np.uint64(0xFFFFFFFFFFFFFFFF)
        b = order.argmin(axis=1)
        tuples[0, s:e], tuples[1, s:e] = h[np.minimum(a, b)], h[np.maximum(a, b)]
    return (mix64(mix64(tuples[0]) + tuples[1]) >> np.uint64(32)).astype(np.uint32)


def hex_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) replaced by the first as many code points of the following text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _ranged(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, heads: dict) -> Iterator[pa.RecordBatch]:
    """Adds each row's range; the first row of a range also goes to the range before it, as its tail."""
    for batch in text_slices(batches):
        ids = batch.column("doc_id").to_pylist()
        # descending: range 0 has the largest ids, rows without id are last
        value = np.array([0 if i is None else i for i in ids], np.int64)
        part = len(bounds) - np.searchsorted(bounds, value, "right")
        part = np.where([i is None for i in ids], len(bounds) + 1, part)
        extra = [j for j, (p, i) in enumerate(zip(part.tolist(), ids, strict=True)) if p in heads and heads[p][0] == i]
        rows = pa.array([*range(len(ids)), *extra], pa.int64())
        to = [*part.tolist(), *(heads[part[j]][1] for j in extra)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("text").take(rows), pa.array(to, pa.int32()),
             pa.array([j >= len(ids) for j in range(len(to))], pa.bool_())], ["doc_id", "text", "part", "tail"])


def _compared(batches: Iterator[pa.RecordBatch], k: int, sketches: int) -> Iterator[pa.RecordBatch]:
    before, ended = None, False
    for batch in text_slices(batches):
        rows = []
        for doc, text, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True):
            if ended:  # further rows of the id that heads the next range
                break
            own = (doc, text, sketch(text, k, sketches))
            if before is not None:
                changed = edited_text(before[1], text)
                other = sketch(changed, k, sketches)
                rows.append((before[0], len(before[1]), hashlib.sha256(changed.encode()).hexdigest(), hex_of(before[2]), hex_of(other),
                             float((before[2] == other).mean()), float((before[2] == own[2]).mean())))
            before, ended = own, tail
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def chained(docs: DataFrame, k: int = KMER, sketches: int = SKETCHES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, its edited text's, and their likeness, with the next row's too.

    Rows stand by descending id, those of one id by text, those without id last; after the last comes the first (a
    single row is its own next). A null text is empty; the empty text's fingerprint is all zeros; texts shorter than a
    k-mer are one k-mer; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / parts for i in range(1, parts)]
    cuts = rows.agg(F.percentile_approx("doc_id", at, 100 * parts).alias("q")).first()["q"] if at else None
    bounds = np.unique(np.array(cuts or [], np.int64))
    last = len(bounds) + 1
    ids = rows.select("doc_id")
    part = F.when(F.col("doc_id").isNull(), last).otherwise(F.lit(len(bounds)) - F.size(F.filter(F.lit(bounds.tolist()).cast("array<bigint>"), lambda b: b <= F.col("doc_id"))))
    found = {r["part"]: r["head"] for r in ids.groupBy(part.cast("int").alias("part")).agg(F.max("doc_id").alias("head")).collect()}
    filled = sorted(found)  # one row per range
    heads = {p: (found[p], filled[i - 1]) for i, p in enumerate(filled)}
    ranged = rows.mapInArrow(lambda b: _ranged(b, bounds, heads), "doc_id bigint, text string, part int, tail boolean")
    spread = ranged.repartitionById(last + 1, F.col("part")).sortWithinPartitions("tail", F.desc_nulls_last("doc_id"), "text")
    return spread.mapInArrow(
        lambda b: _compared(b, k, sketches),
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
