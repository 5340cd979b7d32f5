"""Packing token sequences by multiway Karmarkar-Karp differencing.

Each document's ids (and one closing id) are cut into whole windows, which fill sequences of their own, and a rest, cut
into short pieces. Rests are gathered inside the scan's partitions until about ``windows`` windows' worth of tokens is
there; then differencing divides them: every piece starts as a partial partition with one filled slot, and the two
partial partitions of the largest imbalance are merged over and over, fullest slots of one onto the emptiest of the
other, which leaves near-equal windows. If one of them is over capacity, the window count rises by one and the pieces are divided
anew. No shuffle; memory holds a slice of text and one group of pieces. Sequence numbers are unique and fixed by the
partition and the order of rows in it, so a task that is run again gives the same.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polisframe.llm._shared import byte_alphabet, text_column, text_slices

#: Fixed value: the pattern that splits text before the merges of this kind of vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_COMMON = re.compile("[\t\n\r -~\u00a1-\u00ac\u00ae-\u024f]*")

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


def differencing(sizes: list[int], ways: int) -> tuple[list[list[int]], int]:
    """Divide items into ``ways`` near-equal slots: (items of each slot, largest load)."""
    n = len(sizes)
    left = np.full(2 * n + n * 2, -1, np.int64)  # a node joins two groups of items; nodes below n are the items
    right = left.copy()
    nodes = n
    parts = {}
    heap = []
    for i, size in enumerate(sizes):
        # loads ascending, with the group of items in each slot (-1: none)
        parts[i] = (np.array([size], np.int64), np.array([i], np.int64))
        heap.append((-size, i))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (load_a, group_a), (load_b, group_b) = parts.pop(a), parts.pop(b)
        # only the filled slots are held; the empty ones are those below them
        both = max(0, len(load_a) + len(load_b) - ways)
        if both:  # the smallest filled slots of one meet the smallest of the other, in opposite order
            joined = load_a[:both] + load_b[:both][::-1]
            ids = np.arange(nodes, nodes + both)
            left[ids], right[ids] = group_a[:both], group_b[:both][::-1]
            nodes += both
            load = np.concatenate([joined, load_a[both:], load_b[both:]])
            group = np.concatenate([ids, group_a[both:], group_b[both:]])
        else:
            load, group = np.concatenate([load_a, load_b]), np.concatenate([group_a, group_b])
        order = np.argsort(load, kind="stable")
        load, group = load[order], group[order]
        parts[serial] = (load, group)
        least = int(load[0]) if len(load) == ways else 0
        heapq.heappush(heap, (least - int(load[-1]), serial))
        serial += 1
    if not heap:
        return [], 0
    load, group = parts[heap[0][1]]
    slots = []
    for root in group.tolist():
        items, stack = [], [root]
        while stack:
            node = stack.pop()
            if node < n:
                items.append(node)
            else:
                stack += (int(right[node]), int(left[node]))
        slots.append(items)
    return slots, int(load[-1])


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items of each window: as few windows as the total needs, one more whenever differencing overfills one."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        slots, most = differencing(sizes, ways)
        if most <= capacity:
            return slots
        ways += 1


class _Encoder:
    """Ids of whole texts, as the library of the vocabulary gives them.

    The same merges run faster in the rank form of the vocabulary. It takes the texts of Latin letters, on whose
    character classes all Unicode versions agree; all others go to the library itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.ranked = tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        if len(text) < 1_000_000 and _COMMON.fullmatch(text):
            return self.ranked.encode_to_numpy(text, allowed_special="all")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_WORKER: dict[str, _Encoder] = {}


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, closing: int, piece: int,
            windows: int) -> Iterator[pa.RecordBatch]:
    if path not in _WORKER:
        _WORKER[path] = _Encoder(path)
    encoder, last = _WORKER[path], np.array([closing], "<u4")
    sequence = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    rests: list[tuple] = []
    waiting = 0

    def divide():
        nonlocal sequence
        for slot in windows_of([r[2] for r in rests], capacity):
            offset = 0
            for i in slot:
                rows.append((*rests[i], sequence, offset))
                offset += rests[i][2]
            sequence += 1
        rests.clear()

    def batch():
        columns = list(zip(*rows, strict=True)) or [()] * 7
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], SCHEMA.replace(" bigint", "").split(", "))
        rows.clear()
        return out

    for part in text_slices(batches):
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            ids = np.concatenate([encoder.encode(text), last])
            total = len(ids)
            whole = total - total % capacity
            for start in range(0, whole, capacity):
                rows.append((doc, start, capacity, zlib.crc32(ids[start:start + capacity]), total, sequence, 0))
                sequence += 1
            for start in range(whole, total, piece):
                end = min(total, start + piece)
                rests.append((doc, start, end - start, zlib.crc32(ids[start:end]), total))
                waiting += end - start
            if waiting >= windows * capacity:
                divide()
                waiting = 0
        if rows:
            yield batch()
    divide()
    if rows:
        yield batch()


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, closing: int = 0, piece: int = 256,
         windows: int = 256) -> DataFrame:
    """One row per piece of a document of ``docs`` (doc_id, text): where it begins in its document's ids, its length,
    the CRC of its ids, its document's ids in all, its sequence and its place there.

    ``piece``: longest piece of a rest; ``windows``: windows divided at a time. A null or empty text is its closing id
    alone; a null id stays null; repeated rows are packed each; other columns are ignored; no rows give no rows.
    """
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    return wanted.mapInArrow(lambda batches: _packed(batches, vocabulary, capacity, closing, piece, windows), SCHEMA)
